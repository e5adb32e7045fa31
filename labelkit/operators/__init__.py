"""DataFrame operators."""

from labelkit.operators.annotate import *  # noqa: F401,F403
from labelkit.operators.joins import *  # noqa: F401,F403
from labelkit.operators.metrics import *  # noqa: F401,F403
from labelkit.operators.numbering import *  # noqa: F401,F403
from labelkit.operators.short_forms import *  # noqa: F401,F403
from labelkit.operators.stats import *  # noqa: F401,F403
from labelkit.operators.tables import *  # noqa: F401,F403
from labelkit.operators.vote import *  # noqa: F401,F403
