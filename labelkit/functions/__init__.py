"""Column functions: each takes and returns Columns and stays within one row."""

from labelkit.functions.arrays import *  # noqa: F401,F403
from labelkit.functions.spans import *  # noqa: F401,F403
from labelkit.functions.tags import *  # noqa: F401,F403
from labelkit.functions.text import *  # noqa: F401,F403
from labelkit.functions.voting import *  # noqa: F401,F403
