"""Many-to-one assignment: a candidate goes to one query at most.

Edges are ``(s1, cid, prob)``, best first by (prob desc, s1, cid). Without capacities the
greedy outcome is one window. With capacities it is found in rounds: an edge that is first
for its candidate and among the first free places of its query is what a sequential pass
would take; edges of full queries fall away and free their candidates for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import discard, write_table


def uncapped(edges: DataFrame) -> DataFrame:
    """Each candidate with its best query."""
    order = Window.partitionBy("cid").orderBy(F.desc("prob"), "s1")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def capped(edges: DataFrame, capacity: Column, group: Column | None = None) -> DataFrame:
    """Greedy with at most ``capacity`` candidates for each query (and group, such as the source).

    Each round is a written table, so a lost executor costs one round.
    """
    group = F.lit(0) if group is None else group
    left = write_table(edges.select("s1", "cid", "prob", group.alias("_g"), capacity.cast("int").alias("_free")), "edges")
    parts = []
    by_cid = Window.partitionBy("cid").orderBy(F.desc("prob"), "s1")
    by_query = Window.partitionBy("s1", "_g").orderBy(F.desc("prob"), "cid")
    while not left.isEmpty():
        marked = left.withColumn("_a", F.row_number().over(by_cid)).withColumn("_b", F.row_number().over(by_query))
        taken = write_table(marked.where((F.col("_a") == 1) & (F.col("_b") <= F.col("_free"))).select("s1", "cid", "prob", "_g"), "taken")
        parts.append(taken)
        used = taken.groupBy("s1", "_g").agg(F.count(F.lit(1)).alias("_used"))
        rest = left.join(taken.select("cid"), "cid", "left_anti").join(used, ["s1", "_g"], "left")
        rest = rest.withColumn("_free", F.col("_free") - F.coalesce("_used", F.lit(0))).where("_free > 0").drop("_used")
        after = write_table(rest, "edges")
        discard(left)
        left = after
    if not parts:
        return left.select("s1", "cid", "prob")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("s1", "cid", "prob")


def capped_by_source(edges: DataFrame, s2: int = 5, s3: int = 6) -> DataFrame:
    """Greedy with separate capacities for candidates of S2 and S3; ``edges`` has is_s3."""
    return capped(edges, F.when(F.col("is_s3") == 1, F.lit(s3)).otherwise(F.lit(s2)), F.col("is_s3"))
