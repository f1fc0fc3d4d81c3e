"""Profiles of records, links and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def profile(records: DataFrame) -> DataFrame:
    """By source and country: rows, distinct ids and names, repeated names, missing addresses, and address lengths."""
    n = F.length("address")
    return records.groupBy("src", "country").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("entity_id").alias("ids"),
        F.count_distinct("name").alias("names"),
        (F.count(F.lit(1)) - F.count_distinct("name")).alias("repeated"),
        F.sum((F.col("address") == "").cast("long")).alias("missing"),
        F.min(n).alias("shortest"),
        F.percentile(n, F.lit(0.5)).alias("median"),
        F.avg(n).alias("mean"),
        F.max(n).alias("longest"),
    )


def link_histogram(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(links, queries, s2, s3)``: queries by their number of links, and how many of those go to either source."""
    per = links.groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cid").startswith("S2-").cast("long")).alias("s2"), F.sum(F.col("cid").startswith("S3-").cast("long")).alias("s3"))
    rows = ids.select("s1").join(per, "s1", "left").na.fill(0)
    return rows.groupBy(F.col("n").alias("links")).agg(F.count(F.lit(1)).alias("queries"), F.sum("s2").alias("s2"), F.sum("s3").alias("s3"))


def most_frequent(records: DataFrame, column: str, n: int = 5) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def source_overlap(records: DataFrame, column: str) -> DataFrame:
    """``(a, b, both, only_a, only_b)`` of the distinct values of each pair of sources, from one set of flags a value."""
    flags = records.groupBy(column).agg(*(F.max((F.col("src") == s).cast("int")).alias(s) for s in ("S1", "S2", "S3")))
    pairs = [("S1", "S2"), ("S1", "S3"), ("S2", "S3")]
    sums = flags.agg(*(F.sum(x).alias(f"{a}{b}{k}") for a, b in pairs for k, x in (("b", F.col(a) * F.col(b)), ("x", F.col(a) * (1 - F.col(b))), ("y", F.col(b) * (1 - F.col(a))))))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}{b}b").alias("both"), F.col(f"{a}{b}x").alias("only_a"), F.col(f"{a}{b}y").alias("only_b")) for a, b in pairs])
    return sums.select(F.inline(rows))


def shared_values(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_values(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def stratified(rows: DataFrame, by: list[str], n: int, key: str = "entity_id", seed: int = 42) -> DataFrame:
    """At most n rows of each stratum, by a hash of the key."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def proportional(rows: DataFrame, by: list[str], share: float, key: str) -> DataFrame:
    """The same share of each stratum, rounded up, by a digest of the key."""
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.md5(F.col(key).cast("binary")), key)
    numbered = rows.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count(F.lit(1)).over(whole))
    return numbered.where(F.col("_n") <= F.ceil(F.lit(share) * F.col("_all"))).drop("_n", "_all")


def link_bin(n: Column) -> Column:
    """0, 1-2, 3-5 or 6+ links."""
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")
