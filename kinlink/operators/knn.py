"""Nearest neighbours by inner product of unit vectors.

``exact``: queries and corpus rows are dealt to blocks, every two blocks of a key meet in one
product, and each product keeps its k best before they are merged.
``inverted_lists``: the corpus is dealt to the nearest of some centroids that a bounded sample
gives, and a query looks into its ``probe`` nearest lists only (approximate).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparse import _first_k, _spread

#: Rows of a block, queries of a product that are scored at a time, and sampled rows that centroids are made from.
BLOCK, SLICE, SAMPLE = 16_384, 512, 20_000


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    m = flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("s1").orderBy(F.desc(F.round("score", 9)), "cid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kind(df: DataFrame, name: str) -> str:
    return "string" if df.schema[name].dataType.typeName() == "string" else "long"


def _dealt(rows: DataFrame, own: str, mine: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows with their block ``mine``, once for each block ``other`` of the opposite side."""
    block = F.pmod(F.xxhash64(F.lit(5), own), F.ceil(F.col(f"n_{mine}") / BLOCK)).cast("int")
    met = F.sequence(F.lit(0), F.ceil(F.col(f"n_{other}") / BLOCK).cast("int") - 1)
    # names of their own, as both sides may come from one table
    more = [F.col("docs").alias("docs")] if "docs" in rows.columns else []
    return rows.join(sizes, "key").select(F.col("key").alias("key"), block.alias(mine), F.explode(met).alias(other), F.col(own).alias(own), F.col("v").alias("v"), *more)


def products(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``(s1, cid, score)``: for each two blocks of a key, each query's k best of the block's corpus rows.

    Queries are (key, s1, v), corpus rows (key, cid, v); null keys meet nothing. A task holds two
    blocks and a slice of their product, however many rows a key has. A corpus row may stand for several:
    ``docs`` are then their ids, at least the k least of them, and cid the least.
    """
    kinds = _kind(queries, "s1"), _kind(corpus, "cid")
    q = queries.where("key IS NOT NULL").select("key", F.col("s1").cast(kinds[0]).alias("s1"), "v")
    c = corpus.where("key IS NOT NULL").select("key", F.col("cid").cast(kinds[1]).alias("cid"), "v", *(["docs"] if "docs" in corpus.columns else []))
    count = F.count(F.lit(1))
    sizes = q.groupBy("key").agg(count.alias("n_qb")).join(c.groupBy("key").agg(count.alias("n_cb")), "key")
    schema = pa.schema([("s1", pa.string() if kinds[0] == "string" else pa.int64()), ("cid", pa.string() if kinds[1] == "string" else pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        n = min(k, right.num_rows)
        if not n or not left.num_rows:
            return schema.empty_table()
        right = right.sort_by("cid")  # ties go to the lesser id
        several = "docs" in right.column_names
        if several:
            docs = right["docs"].combine_chunks()
            held, ids = docs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), docs.flatten()
            begins = np.cumsum(held) - held
            place = np.empty(len(ids), np.int64)
            place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        x, y = _unit(left["v"].combine_chunks()), _unit(right["v"].combine_chunks()).T
        out = []
        for at in range(0, len(x), SLICE):
            score = x[at : at + SLICE] @ y
            low = -np.round(score, 9)
            row, col = np.nonzero(low <= np.partition(low, n - 1, axis=1)[:, n - 1 : n])
            order = np.lexsort((col, low[row, col], row))
            row, col = row[order], col[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, col = row[kept], col[kept]
            if several:  # the k best rows stand for all of the k best ids
                score, low, member = np.repeat(score[row, col], held[col]), np.repeat(low[row, col], held[col]), _spread(begins[col], held[col])
                row = np.repeat(row, held[col])
                best_ = _first_k(row, low, place[member], k)
                out.append(pa.Table.from_arrays([left["s1"].take(pa.array(at + row[best_])), ids.take(pa.array(member[best_])), pa.array(score[best_])], schema=schema))
                continue
            out.append(pa.Table.from_arrays([left["s1"].take(pa.array(at + row)), right["cid"].take(pa.array(col)), pa.array(score[row, col])], schema=schema))
        return pa.concat_tables(out)

    deal = ["key", "qb", "cb"]
    dealt = _dealt(q, "s1", "qb", "cb", sizes).groupBy(deal).cogroup(_dealt(c, "cid", "cb", "qb", sizes).groupBy(deal))
    return dealt.applyInArrow(best, f"s1 {kinds[0]}, cid {kinds[1]}, score double")


def exact(queries: DataFrame, corpus: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """``(s1, cid, score, rank)``: the k nearest of ``corpus`` (cid, v) to each of ``queries`` (s1, v).

    Queries are a stated set; with ``within``, only rows that are equal in this column meet. Rows of one key
    and vector are one class and meet as one; of a corpus class only the k least ids can be among the k nearest.
    """
    key = F.lit(0) if within is None else F.col(within)
    cls = F.md5(F.to_json(F.struct("key", "v")))
    q, c = (rows.withColumn("key", key).where("key IS NOT NULL").select("key", own, "v", cls.alias("cls")) for rows, own in ((queries, "s1"), (corpus, "cid")))
    first = [F.first(n).alias(n) for n in ("key", "v")]
    least = c.select("cls", F.col("cid").cast(_kind(corpus, "cid")).alias("cid")).withColumn("_k", F.row_number().over(Window.partitionBy("cls").orderBy("cid"))).where(F.col("_k") <= k)
    right = c.groupBy("cls").agg(*first).join(least.groupBy("cls").agg(F.min("cid").alias("cid"), F.collect_list("cid").alias("docs")), "cls")
    found = products(q.groupBy("cls").agg(*first).withColumnRenamed("cls", "s1"), right, k)
    members = q.select("cls", F.col("s1").cast(_kind(queries, "s1")).alias("s1"))
    near = _best(found, k).select(F.col("s1").alias("cls"), "cid", "score")
    return _best(near.join(members, "cls").select("s1", "cid", "score"), k)


def centroids(corpus: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on at most SAMPLE rows, those of least hashed id."""
    rows = corpus.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("v").collect()
    x = _unit(pa.array([list(r.v) for r in rows]))
    own = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        at = (x @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(norm > 0, sums / np.maximum(norm, 1e-12), own)
    return own


def inverted_lists(queries: DataFrame, corpus: DataFrame, k: int, lists: int = 64, probe: int = 48) -> DataFrame:
    """Like exact(), but each query meets only the corpus rows of its ``probe`` nearest lists."""
    own = centroids(corpus, lists)
    shared = queries.sparkSession.sparkContext.broadcast(own)

    def near(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                m = min(n, len(c))
                at = np.argsort(-(_unit(b.column(1)) @ c.T), axis=1, kind="stable")[:, :m] if b.num_rows and m else np.zeros((b.num_rows, 0), int)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

        return run

    q = queries.select(F.col("s1").alias("id"), "v").mapInArrow(near(probe), "id long, v array<float>, lists array<int>")
    d = corpus.select(F.col("cid").alias("id"), "v").mapInArrow(near(1), "id long, v array<float>, lists array<int>")
    q = q.select(F.col("id").alias("s1"), "v", F.explode("lists").alias("key"))
    d = d.select(F.col("id").alias("cid"), "v", F.explode("lists").alias("key"))
    return _best(products(q, d, k), k)


def similarity(a: Column, b: Column) -> Column:
    from ..functions.similarity import dot

    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(0.0))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A stand-in for a text encoder: signed counts of hashed character trigrams, of length one.

    Any Arrow function from text to array<float> can take its place.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        for t in set(texts):
            low = (t or "").lower()
            v = np.zeros(size, np.float64)
            for i in range(max(1, len(low) - 2)):
                h = crc32(low[i : i + 3].encode("utf-8", "surrogatepass"))
                v[h % size] += 1 if h >> 16 & 1 else -1
            norm = np.sqrt((v * v).sum())
            known[t] = (v / norm if norm else v).astype(np.float32)
        return texts.map(known)

    return embed(text)
