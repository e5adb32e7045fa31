"""Readers and writers."""

from labelkit.sources.archives import *  # noqa: F401,F403
from labelkit.sources.conll import *  # noqa: F401,F403
from labelkit.sources.corpus import *  # noqa: F401,F403
