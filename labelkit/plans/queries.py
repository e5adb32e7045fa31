"""All registered queries."""

from labelkit.plans import (corpus_queries, span_queries, tag_queries,  # noqa: F401
                             text_queries)
from labelkit.plans.registry import ORACLES, QUERIES  # noqa: F401
