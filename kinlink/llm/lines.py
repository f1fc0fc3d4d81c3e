"""Line dedup over levelled sorted runs of line hashes.

Runs hold ``(h1, h2, owner)``: a line's 128-bit hash and the smallest doc_id that holds it.
A run is a table bucketed and sorted by hash. A batch of documents brings its own
keys, merge-anti-joins them with the runs, and what is new becomes a run of level 0; once a
level holds ``fanout`` runs they are merged into one run of the next level. Batches must come
in order of doc_id, as the first holder keeps a line; dedup() cuts them by doc_id.

A line of a document goes unless the runs name that very document as its owner, so
occurrences meet the runs by (hash, doc_id): even a line of every document spreads over
all partitions. Per key, one pre-aggregated row of each batch meets the runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete_path, materialize, read_table, scratch, shared_root, slices

SPACE = b" \t\n\v\f\r"
#: Keys of fewer code points than this are never dropped.
LEAST = 10
#: Batches that dedup() cuts a table into at least, occurrences of a batch, and runs of a level before they are merged.
BATCHES, BATCH_ROWS = 3, 1 << 31
FANOUT = 2


def line_keys(text: str | None) -> list[bytes | None]:
    """For each line its 16-byte hash, or None where the key is too short to be dropped."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE).lower()
        if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "surrogatepass")) < LEAST:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id)`` once for each document and key; documents without an id hold none."""
    names = ["h1", "h2", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, ids = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {k for k in line_keys(t) if k}
                keys += own
                ids += [i] * len(own)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long")


class Runs:
    """Levels of sorted runs in the shared folder.

    A run is a table bucketed and sorted by hash, so a merge join reads it as it lies; only the batch is dealt anew.
    Tables that a compaction replaces are deleted: results that read them must be written by then, as dedup()'s are.
    """

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[tuple[DataFrame, str, str]]] = []

    def tables(self) -> list[DataFrame]:
        return [r[0] for level in self.levels for r in level]

    @staticmethod
    def _write(rows: DataFrame, level: int) -> tuple[DataFrame, str, str]:
        spark = rows.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"kinlink_run{level}_{uuid.uuid4().hex}"
        path = f"{shared_root(spark)}/{name}"
        rows.write.option("path", path).bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return spark.table(name), name, path

    @staticmethod
    def _drop(run: tuple[DataFrame, str, str]) -> None:
        df, name, path = run
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(df.sparkSession, path)

    def drop(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []

    def _push(self, run: tuple[DataFrame, str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        own = self.levels[level]
        own.append(run)
        if len(own) >= self.fanout:
            merged = own[0][0]
            for r in own[1:]:
                merged = merged.unionByName(r[0])
            buckets = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            run = self._write(merged.repartition(buckets, "h1", "h2"), level + 1)
            for r in own:
                self._drop(r)
            self.levels[level] = []
            self._push(run, level + 1)

    def add(self, rows: DataFrame) -> None:
        """Take in a batch's occurrences: keys the runs lack get their smallest doc_id as owner.

        Runs never share a key, so merging them is a union.
        """
        fresh = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for r in self.tables():
            fresh = fresh.join(r.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(self._write(fresh, 0), 0)

    def dropped(self, rows: DataFrame) -> DataFrame:
        """Occurrences whose key another document owns."""
        owners = None
        for r in self.tables():
            own = r.select("h1", "h2", F.col("owner").alias("doc_id"))
            owners = own if owners is None else owners.unionByName(own)
        return rows.join(owners.hint("merge"), ["h1", "h2", "doc_id"], "left_anti") if owners is not None else rows


def _bounds(rows: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut the documents in about equal batches, by approximate quantiles."""
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / batches) for k in range(1, batches)]), F.lit(1000))).first()[0]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, batches: int | None = None, runs: Runs | None = None) -> DataFrame:
    """``(doc_id, drop)``: the 16-byte hashes of the lines that each document loses; a table of its own.

    Given ``runs`` of earlier documents (all of smaller ids), lines that those hold go too, and the runs stay.
    """
    own = runs or Runs()
    with scratch(docs.sparkSession):
        rows = materialize(occurrences(docs), "lines")
        if batches is None:
            batches = max(BATCHES, -(-rows.count() // BATCH_ROWS))
        cuts = _bounds(rows, batches) if batches > 1 else []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows
            if low is not None:
                part = part.where(F.col("doc_id") > low)
            if high is not None:
                part = part.where(F.col("doc_id") <= high)
            own.add(part)
        gone = own.dropped(rows).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))
        gone = materialize(gone, "gone", keep=True)
    if runs is None:
        own.drop()
    return gone


def dedup(docs: DataFrame, batches: int | None = None, runs: Runs | None = None) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of white space with A-Z in lower case. Of keys with at
    least ten code points that two documents hold, only the one of smallest doc_id keeps its
    lines, all of them. Null texts count as one empty line and become empty texts; rows
    without a doc_id stay as they are; columns named n_lines or n_dropped are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_lines(docs, batches, runs).select(F.col("doc_id").alias("_gone_id"), F.col("drop").alias("_gone"))
    both = docs.select(*names).join(gone, F.col("doc_id").cast("long") == F.col("_gone_id"), "left").drop("_gone_id")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            drops = b.column(len(names))
            texts, lines, lost = [], [], []
            h1, h2 = (drops.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            packed = np.stack([h1, h2], 1).astype("<i8")
            sizes = np.diff(drops.offsets.to_numpy()) if len(drops) else []
            ends = np.cumsum(sizes)
            for t, n, e in zip(b.column(at).to_pylist(), sizes, ends, strict=True):
                own = (t or "").split("\n")
                lines.append(len(own))
                if n:
                    raw = packed[e - n : e].tobytes()
                    out = {raw[k : k + 16] for k in range(0, len(raw), 16)}
                    own = [x for x, k in zip(own, line_keys(t), strict=True) if k not in out]
                texts.append("\n".join(own))
                lost.append(lines[-1] - len(own))
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return both.mapInArrow(run, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by dedup(): null texts are one empty line, rows without an id stay whole, extra columns are not read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
r AS (SELECT k.doc_id, k.n, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
