"""The registered queries over the given tables and the SQL that checks them."""

from . import column_queries, known_queries, link_queries, merge_queries, row_queries, search_queries  # noqa: F401  (they register themselves)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
