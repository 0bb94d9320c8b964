"""All registered queries."""

from . import graph_queries, quality_queries, source_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
