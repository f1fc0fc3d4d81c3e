"""Checks of result files. Each finding is ``(check, severity, n, examples)``; errors fail, warnings do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5


def _finding(check: str, severity: str, bad: DataFrame, example: Column) -> DataFrame:
    """How many rows are bad, and the least few of them."""
    least = bad.select(example.cast("string").alias("x")).orderBy("x").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"), F.lit(1).alias("_k"))
    count = bad.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_k"))
    return count.join(least, "_k").select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "examples")


def check_lines(spark: SparkSession, path: str, header: tuple[str, str]) -> DataFrame:
    """Header and form of the raw lines: tabs, not commas; UTF-8."""
    lines = spark.read.text(path)
    first = "\t".join(header)
    rows = lines.where(F.col("value") != first)
    found = _finding("header", "error", lines.where(F.col("value") == first).agg(F.count(F.lit(1)).alias("n")).where("n = 0"), F.lit(first))
    found = found.unionByName(_finding("csv", "error", lines.where(F.col("value") == ",".join(header)), F.col("value")))
    found = found.unionByName(_finding("no_tab", "error", rows.where(~F.col("value").contains("\t")), F.col("value")))
    return found.unionByName(_finding("utf8", "error", lines.where(F.col("value").contains("�")), F.col("value")))


def check_links(rows: DataFrame, s1: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Findings of link rows (source1_entity_id, ids) against the queries (entity_id); unknown ids only if ``corpus`` is given."""
    key, ids = rows.columns[:2]
    own = rows.select(F.col(key).alias("s1"), F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "").alias("l"))
    edges = own.select("s1", F.explode("l").alias("cid"))
    twice = F.filter(F.array_distinct("l"), lambda x: F.size(F.filter("l", lambda y: y == x)) > 1)
    queries = s1.select(F.col("entity_id").alias("s1")).distinct()
    out = [
        _finding("duplicate_row", "error", own.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("s1")),
        _finding("duplicate_id", "error", own.select("s1", F.explode(twice).alias("cid")), F.concat_ws(":", "s1", "cid")),
        _finding("query_as_match", "error", edges.where(F.col("cid").startswith("S1-")), F.concat_ws(":", "s1", "cid")),
        _finding("prefix", "error", edges.where(~F.col("cid").rlike("^S[123]-")), F.concat_ws(":", "s1", "cid")),
        _finding("missing_row", "error", queries.join(own.select("s1"), "s1", "left_anti"), F.col("s1")),
        _finding("extra_row", "error", own.select("s1").distinct().join(queries, "s1", "left_anti"), F.col("s1")),
        _finding("empty", "info", own.where(F.size("l") == 0), F.col("s1")),
    ]
    if corpus is not None:
        known = corpus.select(F.col("entity_id").alias("cid"))
        out.append(_finding("unknown_id", "error", edges.join(known, "cid", "left_anti"), F.concat_ws(":", "s1", "cid")))
    found = out[0]
    for f in out[1:]:
        found = found.unionByName(f)
    return found


def check_subset(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates: a warning."""
    return _finding("not_candidate", "warning", links.select("s1", "cid").join(candidates.select("s1", "cid"), ["s1", "cid"], "left_anti"), F.concat_ws(":", "s1", "cid"))


def passed(findings: DataFrame) -> DataFrame:
    return findings.agg((F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n"))), F.lit(0)) == 0).alias("passed"))


def check_table(rows: DataFrame, expected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: equal counts, the columns asked for, equal order of keys (both have ord), no null or not-a-number."""
    named = rows.columns == columns
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in rows.columns:
        bad = bad | F.col(c).isNull()
    for c in numbers:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    a = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("bad"), F.lit(1).alias("_k"))
    b = expected.agg(F.count(F.lit(1)).alias("expected"), F.lit(1).alias("_k"))
    left, right = rows.select("ord", F.col(key).alias("x")), expected.select("ord", F.col(key).alias("y"))
    moved = left.join(right, "ord", "full").where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.count(F.lit(1)).alias("moved"), F.lit(1).alias("_k"))
    return a.join(b, "_k").join(moved, "_k").select("rows", "expected", "bad", "moved", F.lit(named).alias("columns"))


def duplicate_assignments(links: DataFrame) -> DataFrame:
    """Candidates of several queries: ``(cid, n)``."""
    return links.groupBy("cid").agg(F.count_distinct("s1").alias("n")).where("n > 1")


def gate(metrics: DataFrame, recall: float, f05: float) -> DataFrame:
    """Whether blocking recall and F0.5 (one row with both) beat the last ones."""
    return metrics.select("recall", "f05", ((F.col("recall") > recall) & (F.col("f05") > f05)).alias("passed"))
