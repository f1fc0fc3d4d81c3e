"""The best products of sparse rows: equal texts as one class, blocks of classes that meet in one product.

Records that have the same text score alike, so a country's records meet as classes of equal texts. Of a class
of the corpus only its k least ids can be among a query's k best. Each two blocks of classes meet in a task that
adds the products of shared terms and keeps the k best of a query; no pair is written before that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectorize as vz
from .tables import write_table

#: Classes of a block of queries and of the corpus, and products that are added up at a time.
QUERIES, CORPUS, SLICE = 32_768, 131_072, 1 << 22


def _classes(docs: DataFrame, sample: Column | None) -> tuple[DataFrame, bool]:
    """``docs`` with their ``texts`` and class ``cls``; whether some doc has several rows or no id.

    The rows of such a doc are put together, and it is a class by itself: ``own`` is its doc.
    """
    flag = F.lit(1) if sample is None else F.coalesce(sample, F.lit(False)).cast("int")
    rows = docs.where("country IS NOT NULL").select("country", "doc", "side", flag.alias("m"), F.array("_x").alias("texts"))
    several = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR doc IS NULL").select(F.col("doc").alias("_doc"))
    split = not several.isEmpty()
    one = rows.withColumn("alone", F.lit(False))
    if split:
        same = F.col("doc").eqNullSafe(F.col("_doc"))
        own = rows.join(several, same, "left_semi").withColumn("m", F.max("m").over(Window.partitionBy("doc")))
        own = own.groupBy("country", "doc", "side").agg(F.max("m").alias("m"), F.flatten(F.collect_list("texts")).alias("texts"))
        one = one.join(several, same, "left_anti").unionByName(own.withColumn("alone", F.lit(True)))
    out = one.withColumn("own", F.when(F.col("alone"), F.col("doc")))
    return out.withColumn("cls", F.unhex(F.md5(F.to_json(F.struct("country", "side", "alone", "own", "texts"))))), split


def _weighted(docs: DataFrame, terms: Callable[[Column], Column], v: vz.Vectorizer, k: int, sample: Column | None) -> tuple[DataFrame, DataFrame, bool]:
    """Classes (country, side, cls, entries, norm, n, docs) as a table, their members, and whether some stand alone."""
    rows, split = _classes(docs, sample)
    first = [F.first(c).alias(c) for c in ("country", "side", "own")]
    groups = rows.groupBy("cls").agg(*first, F.first("texts").alias("texts"), F.max(F.col("alone").cast("int")).alias("alone"), F.sum("m").alias("m"))
    named = ["cls", "country", "side", "own", "alone", "m"]
    bag = F.flatten(F.transform(F.filter("texts", lambda x: x.isNotNull()), lambda x: terms(x)))
    counts = groups.select(*named, F.explode(bag).alias("term")).groupBy(*named, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = vz.vocabulary(counts.where("m > 0"), docs if sample is None else docs.where(sample), v)
    entries = counts.join(vocab, ["country", "term"]).withColumn("w", vz.raw_weight(v))
    square, size = F.sum(F.col("w") * F.col("w")).alias("square"), F.count(F.lit(1)).alias("n")
    kept = entries.groupBy("cls").agg(*first, F.collect_list(F.struct("place", "w")).alias("entries"), square, size)
    if split:  # a row is as long as all of its doc
        whole = entries.where("own IS NOT NULL").groupBy("own").agg(square.alias("_s"), size.alias("_n"))
        kept = kept.join(whole, "own", "left").withColumn("square", F.coalesce("_s", "square")).withColumn("n", F.coalesce("_n", "n"))
    members = rows.where("doc IS NOT NULL").select("cls", "side", "doc")
    least = members.where("side <> 'S1'").withColumn("_k", F.row_number().over(Window.partitionBy("cls").orderBy("doc"))).where(F.col("_k") <= k)
    kept = kept.join(least.groupBy("cls").agg(F.collect_list("doc").alias("docs")), "cls", "left")
    kept = kept.select("country", "side", "cls", "entries", F.sqrt("square").alias("norm"), "n", "docs")
    return write_table(kept.where("side = 'S1' OR docs IS NOT NULL"), "classes"), members.where("side = 'S1'").select("cls", F.col("doc").alias("s1")), split


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of all entries."""
    lists = rows["entries"].combine_chunks()
    flat = lists.flatten()
    count = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(count)), count), flat.field("place").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., counts[0] of them, then those of starts[1], ..."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)


def _first_k(row: np.ndarray, low: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (low, tie) of each row, in that order."""
    order = np.lexsort((tie, low, row))
    at = row[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def _near(row: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places, of sorted rows, that are no worse than the k-th least value of their row."""
    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, int)
    kept = np.ones(len(row), bool)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > k:
            own = low[a:b]
            kept[a:b] = own <= np.partition(own, k - 1)[k - 1]
    return np.flatnonzero(kept)


def block_product(left: pa.Table, right: pa.Table, k: int, jaccard: bool, schema: pa.Schema) -> pa.Table:
    """``(cls, cid, score)``: the k best members of right's classes for each class of left."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    docs = right["docs"].combine_chunks()
    held = docs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = docs.flatten()
    order = pa.compute.sort_indices(ids).to_numpy()
    place = np.empty(len(ids), np.int64)  # ids by their order, ties go to the lesser
    place[order] = np.arange(len(ids))
    begins = np.concatenate(([0], np.cumsum(held)[:-1]))
    least = np.minimum.reduceat(place, begins)

    col, term, b = _flat(right)
    by = np.argsort(term, kind="stable")
    col, b = col[by], b[by]
    ends = np.cumsum(np.bincount(term, minlength=1))
    row, term, a = _flat(left)
    known = term < len(ends)
    row, term, a = row[known], term[known], a[known]
    count = ends[term] - np.where(term > 0, ends[term - 1], 0)
    start = ends[term] - count
    x, y = (left[c].to_numpy() for c in ("n", "norm")), (right[c].to_numpy() for c in ("n", "norm"))
    (n_left, norm_left), (n_right, norm_right) = x, y
    work = np.cumsum(np.bincount(row, count, left.num_rows))
    wide, at, out = right.num_rows, 0, []
    while at < left.num_rows:
        before = work[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(work, before + SLICE, "right")))
        lo, hi = np.searchsorted(row, (at, to))
        c, s = count[lo:hi], _spread(start[lo:hi], count[lo:hi])
        cell = np.repeat((row[lo:hi] - at) * wide, c) + col[s]
        value = np.repeat(a[lo:hi], c) * b[s]
        if (to - at) * wide <= 8 * len(cell):
            every = np.bincount(cell, value, (to - at) * wide)
            cell = np.flatnonzero(every)
            score = every[cell]
        else:
            cell, which = np.unique(cell, return_inverse=True)
            score = np.bincount(which, value, len(cell))
        q, d = cell // wide, cell % wide
        score = score / (n_left[at + q] + n_right[d] - score) if jaccard else score / (norm_left[at + q] * norm_right[d])
        low = -np.round(score, 9)
        near = _near(q, low, k)
        near = near[_first_k(q[near], low[near], least[d[near]], k)]
        q, d, score, low = q[near], d[near], score[near], low[near]
        member = _spread(begins[d], held[d])
        q, score, low = (np.repeat(z, held[d]) for z in (q, score, low))
        best = _first_k(q, low, place[member], k)
        out.append(pa.Table.from_arrays([left["cls"].take(pa.array(at + q[best])), ids.take(pa.array(member[best])), pa.array(score[best])], schema=schema))
        at = to
    return pa.concat_tables(out).combine_chunks()


def _dealt(rows: DataFrame, sizes: DataFrame, mine: str, most: int, other: str, others: int) -> DataFrame:
    """Classes with their block ``mine``, once for each block ``other`` of the opposite side."""
    block = F.pmod(F.xxhash64(F.lit(5), "cls"), F.ceil(F.col(f"n_{mine}") / most)).cast("int")
    met = F.sequence(F.lit(0), F.ceil(F.col(f"n_{other}") / others).cast("int") - 1)
    # names of their own, as both sides come from one table
    own = [F.col(c).alias(c) for c in ("cls", "entries", "norm", "n", "docs")]
    return rows.join(F.broadcast(sizes), "country").select(F.col("country").alias("country"), block.alias(mine), F.explode(met).alias(other), *own)


def best_products(docs: DataFrame, terms: Callable[[Column], Column], v: vz.Vectorizer, k: int, sample: Column | None = None) -> DataFrame:
    """``(s1, cid, score, rank)``: each S1 record's k best of the others by cosine (or Jaccard, if binary) of terms(_x).

    ``docs`` are (country, doc, side, _x); scores count to nine digits, ties go to the lesser cid.
    """
    table, members, split = _weighted(docs, terms, v, k, sample)
    left, right = table.where("side = 'S1'"), table.where("side <> 'S1'")
    count = F.count(F.lit(1))
    # a row for each country
    sizes = left.groupBy("country").agg(count.alias("n_qb")).join(right.groupBy("country").agg(count.alias("n_cb")), "country")
    text = docs.schema["doc"].dataType.typeName() == "string"
    schema = pa.schema([("cls", pa.binary()), ("cid", pa.string() if text else pa.int64()), ("score", pa.float64())])
    deal = ["country", "qb", "cb"]
    both = _dealt(left, sizes, "qb", QUERIES, "cb", CORPUS).groupBy(deal).cogroup(_dealt(right, sizes, "cb", CORPUS, "qb", QUERIES).groupBy(deal))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_product(a, b, k, v.binary, schema)

    found = both.applyInArrow(best, f"cls binary, cid {'string' if text else 'long'}, score double")
    out = vz.top_k(found, k, "cls").join(members, "cls").select("s1", "cid", "score", "rank")
    return vz.top_k(out.drop("rank"), k) if split else out
