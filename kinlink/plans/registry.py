"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import queries_blocking, queries_eval, queries_links, queries_text  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "resolve_baseline"

#: Places that row_number() counts have 32 bits in Spark.
PLACES = {
    "rank": ("blk6_top_k", "blk13_index_union", "blk14_two_channel_union", "blk15_exact_neighbours", "blk16_merge_neighbours", "win1_rank", "win4_order_by_score", "ml7_hard_negatives"),
    "ord": ("resolve_baseline",),
}
for _column, _names in PLACES.items():
    for _name in _names:
        ORACLES[_name] = f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM ({ORACLES[_name]}) places"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
