"""Connected components by alternating large-star and small-star rounds.

Links stay distributed; each round is written to the shared folder, so a lost executor
repeats one round at most. Hub nodes meet their links in joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node that has a link to another; component = smallest node.

    Nulls and links of a node to itself are ignored; an empty table gives an empty result.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: both sides of the join then come as they are dealt, and AQE can split a hub's links
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "ccnear")
        large = edges.join(near, edges.v == near.x).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(edges)
        discard(near)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
