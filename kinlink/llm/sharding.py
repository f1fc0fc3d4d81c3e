"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so equal texts stand together. A
size-weighted sample of keys gives quantile boundaries; a quantile on which one text weighs
more than a range's share is subdivided by doc_id. Records find their range by a two-level
search in literal splitters. The exact sizes of ranges (a few thousand rows at most) then
turn running sums within ranges into global offsets, and the offset's eighth is the shard:
ranges that straddle an edge are subdivided exactly, whatever the sample was like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table, scratch

#: Sampled keys (a bound for what the driver holds), and bytes a range should have.
SAMPLE = 20_000
RANGE_BYTES = 256 << 20
#: Ranges at least and at most; FANOUT ** 3 is what the search can tell apart.
LEAST_RANGES, FANOUT = 64, 16
#: A group of equal texts is kept in one shard if it has at most this part of a shard.
SNAP = 0.01


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the text's hash; a null text is empty and has size 1."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def sample_keys(rows: DataFrame, total: int, wanted: int = SAMPLE) -> list[tuple[int, int, float]]:
    """Keys drawn with a chance in proportion to size; one that is sure to be drawn keeps its weight."""
    share = F.col("size") * F.lit(wanted / max(total, 1))
    # pseudo-random and the same on each run
    u = (F.pmod(F.xxhash64(F.lit(11), "_d", "h"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = rows.where(u < share).select("h", F.col("_d").alias("d"), F.greatest(share, F.lit(1.0)).alias("w"))
    return [tuple(r) for r in drawn.collect()]


def splitters(keys: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Weighted quantiles of the sampled keys; at a text heavier than a range, by doc_id, else by text."""
    keys = sorted(keys)
    weight = sum(w for *_, w in keys)
    heavy: dict[int, float] = {}
    for h, _, w in keys:
        heavy[h] = heavy.get(h, 0.0) + w
    out, run, at = set(), 0.0, 1
    for h, d, w in keys:
        run += w
        while at < ranges and run >= weight * at / ranges:
            out.add((h, d) if heavy[h] > weight / ranges else (h, -(1 << 63)))
            at += 1
    return sorted(out)


def _count_below(points: list[tuple[int, int]]) -> Column:
    """How many of the points are at or below the row's key."""
    if not points:
        return F.lit(0)
    said = ",".join(f"named_struct('h',{_long(h)},'d',{_long(d)})" for h, d in points)
    return F.size(F.filter(F.expr(f"array({said})"), lambda s: (s.h < F.col("h")) | ((s.h == F.col("h")) & (s.d <= F.col("_d")))))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else f"({x + 1}L - 1L)"


def _groups_below(points: list[list[tuple[int, int]]], at: Column) -> Column:
    said = ",".join("array(" + ",".join(f"named_struct('h',{_long(h)},'d',{_long(d)})" for h, d in g) + ")" for g in points)
    own = F.element_at(F.expr(f"array({said})"), at + 1)
    return F.size(F.filter(own, lambda s: (s.h < F.col("h")) | ((s.h == F.col("h")) & (s.d <= F.col("_d")))))


def range_of(points: list[tuple[int, int]]) -> Column:
    """The range of a row: its place among the splitters, by two searches of about sqrt(n) points."""
    if len(points) <= FANOUT:
        return _count_below(points)
    step = max(FANOUT, int(len(points) ** 0.5))
    groups = [points[i : i + step] for i in range(0, len(points), step)]
    coarse = F.greatest(_count_below([g[0] for g in groups]) - 1, F.lit(0))
    return coarse * step + _groups_below(groups, coarse)


def place(rows: DataFrame, shards: int, law: str = "bytes", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rows`` of records() with ``shard`` and ``slot``; laws are "bytes" and "rows".

    "bytes" gives shards of near equal size: an edge moves at most SNAP of a shard to keep
    equal texts together, else their documents are parted by doc_id. "rows" gives counts
    that differ by one at most. Slots run from 0 without gaps; ties are rows alike.
    An empty table gives no rows.
    """
    with scratch(rows.sparkSession):
        # rows without an id are told apart by where they stand
        tie = F.coalesce("doc_id", F.lit(-(1 << 63)) + F.monotonically_increasing_id())
        rows = materialize(rows.withColumn("_d", tie), "records")
        total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        ranges = min(FANOUT**3, max(LEAST_RANGES, total // range_bytes))
        points = splitters(sample_keys(rows, total), ranges)
        rows = rows.withColumn("range", range_of(points))
        # a few thousand rows at most: FANOUT ** 3 ranges
        sizes = sorted(rows.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect())
        before, b, n = [], 0, 0
        for r, rb, rn in sizes:
            before.append((r, b, n))
            b, n = b + rb, n + rn
        starts = rows.sparkSession.createDataFrame(before, "range int, _b0 long, _n0 long")
        own = Window.partitionBy("range").orderBy("h", "_d", "text_crc32", "size")
        run = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        alike = Window.partitionBy("range", "h")
        placed = (
            rows.withColumn("_run", F.sum("size").over(run) - F.col("size"))
            .withColumn("_row", F.row_number().over(own) - 1)
            .join(F.broadcast(starts), "range")
            .withColumn("_at", F.col("_b0") + F.col("_run"))
            .withColumn("_gat", F.min("_at").over(alike))
            .withColumn("_gsize", F.sum("size").over(alike))
            .withColumn("_g", F.col("_n0") + F.col("_row"))
        )
        if law == "rows":
            shard = F.floor(F.col("_g") * shards / F.lit(max(count, 1)))
        else:
            snug = F.col("_gsize") <= F.lit(SNAP * total / shards)
            # a record or group goes where its middle lies
            middle = F.when(snug, F.col("_gat") + F.col("_gsize") / 2).otherwise(F.col("_at") + F.col("size") / 2)
            shard = F.floor(middle * shards / F.lit(max(total, 1)))
        placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
        placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "_g"), "placed", keep=True)
        firsts = placed.groupBy("shard").agg(F.min("_g").alias("_first"))  # a row for each shard
        return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_g") - F.col("_first")).drop("_g", "_first")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by place(): null texts have size 1, null ids are placed too, repeated rows stay, extra columns are not read."""
    placed = place(records(read_table(spark, sf_dir, "documents")), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
