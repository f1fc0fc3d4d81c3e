"""Candidate channels: similarity joins and inverted indexes within a country, and their union.

Records come as one row each with ``doc, side, country`` and the normalised columns of
plans/normalize.py. Channels give ``(s1, cid, score)``; unions are long tables, never wide
joins. Index keys that too many corpus records share are left out before the join, which is
the channel's rule and bounds what one key can produce.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import sparse
from . import vectorize as vz
from .packs import opened, pack

#: Parts of the queries whose pairs are ranked at a time, rows that are packed at a time, and rows that are given on at a time.
BUCKETS, PACKED, GIVEN = 128, 1 << 20, 10_000
CHANNELS = ("word", "addr", "char", "sorted", "five", "phonetic", "prefix")


def term_channel(records: DataFrame, text: Column, v: vz.Vectorizer, k: int, sample: Column | None = None, terms: Callable[[Column], Column] = vz.word_terms) -> DataFrame:
    """Top-k cosine (or, for a binary vectorizer, Jaccard) of each S1 record's terms with the corpus."""
    docs = records.select("country", "doc", "side", *(["ord"] if "ord" in records.columns else []), text.alias("_x"))
    return sparse.best_products(docs, terms, v, k, sample).select("s1", "cid", "score")


def _sides(records: DataFrame, key: Column, *columns: str) -> tuple[DataFrame, DataFrame]:
    rows = records.select("country", "doc", "side", key.alias("key"), *columns).where("key IS NOT NULL AND key <> ''")
    left = rows.where("side = 'S1'").select("country", F.col("doc").alias("s1"), "key", *(F.col(c).alias(f"a_{c}") for c in columns))
    right = rows.where("side <> 'S1'").select("country", F.col("doc").alias("cid"), "key", *(F.col(c).alias(f"b_{c}") for c in columns))
    return left, right


def index_pairs(records: DataFrame, key: Column, most: int | None, *columns: str) -> DataFrame:
    """Pairs with an equal key; keys of more than ``most`` corpus records are left out. Keeps a_/b_ columns."""
    left, right = _sides(records, key, *columns)
    if most is not None:
        size = right.groupBy("country", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most)
        right = right.join(size, ["country", "key"], "left_semi")
    return left.join(right, ["country", "key"])


def _overlap() -> Column:
    return F.arrays_overlap("a_name_words", "b_name_words")


def spaceless_channel(records: DataFrame, most: int = 200) -> DataFrame:
    """Names equal without blanks, four characters or more."""
    key = F.when(F.length("name_spaceless") >= 4, F.col("name_spaceless"))
    return index_pairs(records, key, most).select("s1", "cid", F.lit(0.85).alias("score"))


def postal_channel(records: DataFrame, most: int = 2000) -> DataFrame:
    """Equal postal codes and a common name word."""
    return index_pairs(records, F.col("pc"), most, "name_words").where(_overlap()).select("s1", "cid", F.lit(0.40).alias("score"))


def phonetic_channel(records: DataFrame, most: int = 500) -> DataFrame:
    """A common consonant skeleton and a common name word."""
    rows = records.withColumn("_key", F.explode("phonetic_keys"))
    return index_pairs(rows, F.col("_key"), most, "name_words").where(_overlap()).select("s1", "cid", F.lit(0.85).alias("score")).distinct()


def prefix_channel(records: DataFrame, most: int = 300) -> DataFrame:
    """Equal first three characters; the score is the Jaccard of the name words."""
    from ..functions.similarity import jaccard

    pairs = index_pairs(records, F.col("first3"), most, "name_words")
    return pairs.select("s1", "cid", jaccard(F.col("a_name_words"), F.col("b_name_words")).alias("score")).where("score > 0")


def premise_channel(records: DataFrame, most: int = 10) -> DataFrame:
    """Equal city (three characters or more) and house number."""
    key = F.when((F.length("city") >= 3) & (F.col("hn") != ""), F.concat_ws("|", "city", "hn"))
    return index_pairs(records, key, most).select("s1", "cid", F.lit(0.0).alias("score"))


def key_channel(records: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """Pairs with any equal key."""
    return index_pairs(records, key, most).select("s1", "cid", F.lit(0.0).alias("score")).distinct()


#: What an index channel writes into the seven slots of a pair that no earlier channel found.
NEW_PAIR = {
    "spaceless": (0.85, 0.0, 0.85, 0.85, 0.85, 0.0, 0.0),
    "postal": (0.40, 0.30, 0.40, 0.40, 0.40, 0.0, 0.0),
    "phonetic": (0.40, 0.0, 0.40, 0.0, 0.0, 0.85, 0.0),
}
#: The order channels come in, and the slot each one writes.
ORDER = (("word", 0), ("addr", 1), ("char", 2), ("sorted", 3), ("spaceless", 4), ("postal", 4), ("phonetic", 5), ("prefix", 6))


def ordered_union(channels: dict[str, DataFrame], most: int) -> DataFrame:
    """One row for each pair with seven slots, whether it was really hit by each channel, and its rank.

    A pair's first channel decides its start: index channels fill several slots of a pair that
    is new to them. Later channels raise their own slot. Ranked by the greatest slot (nine
    digits, then the lesser candidate), at most ``most`` of a query.
    """
    made = [(name, slot) for name, slot in ORDER if name in channels]
    starts = np.array([NEW_PAIR.get(name, (0.0,) * 7) for name, _ in made])
    return _united([channels[name] for name, _ in made], [slot for _, slot in made], [f"s_{c}" for c in CHANNELS], most, starts)


def simple_union(channels: dict[str, DataFrame], most: int) -> DataFrame:
    """Pairs of any channel with each channel's score (zero where it did not fire), ranked and capped."""
    return _united(list(channels.values()), list(range(len(channels))), [f"s_{c}" for c in channels], most)


def _nine(x: np.ndarray) -> np.ndarray:
    """x to nine digits, in units of the last, halves away from zero as decimals (as Spark's round())."""
    y = x * 1e9
    out = np.rint(y)
    for k in np.flatnonzero((np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-3) | (np.abs(x) > 1e4)).tolist():
        out[k] = float(Decimal(repr(float(x[k]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the different ones in order, from 1 (0 for null), and those values."""
    own = column.combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(own.dictionary).to_numpy()
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(1, len(order) + 1), 0
    return place[own.indices.fill_null(-1).to_numpy(zero_copy_only=False)], own.dictionary.take(pa.array(order))


def _united(channels: list[DataFrame], slot: list[int], names: list[str], most: int, starts: np.ndarray | None = None) -> DataFrame:
    """Pairs of all channels, a row each: slots ``names``, with ``starts`` the number of hits, the greatest slot and the rank.

    Each channel raises its ``slot``. Queries go to BUCKETS; a bucket's pairs are dealt once, compressed, and ranked where they meet.
    """
    kind = reduce(DataFrame.unionByName, [df.select("s1", "cid").limit(0) for df in channels]).schema
    # numbers of one byte for the channels
    long = reduce(DataFrame.unionByName, [df.select("s1", "cid", F.lit(n).cast("byte").alias("n"), F.col("score").cast("double").alias("score")) for n, df in enumerate(channels)])
    bucket = F.pmod(F.xxhash64(F.lit(11), "s1"), F.lit(BUCKETS)).cast("int")
    packed = long.select(bucket.alias("_b"), F.lit(0).alias("_none"), "*").mapInArrow(pack("_b", "_none", PACKED), "_b int, _none int, _blob binary")
    parts = min(BUCKETS, 4 * long.sparkSession.sparkContext.defaultParallelism)
    dealt = packed.select("_b", "_blob").repartitionById(parts, F.col("_b") % parts).sortWithinPartitions("_b")
    schema = T.StructType([*kind.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    schema = (schema if starts is None else schema.add("channels_hit", T.LongType())).add("score", T.DoubleType()).add("rank", T.IntegerType())

    def ranked(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(tables)
        (s, queries), (c, ids) = _numbered(rows["s1"]), _numbered(rows["cid"])
        n, score = rows["n"].to_numpy(), rows["score"].to_numpy()
        wide = len(ids) + 1
        key, at = np.unique(s * wide + c, return_inverse=True)
        made, first = np.full((len(names), len(key)), -np.inf), np.zeros(len(key), np.int64)
        for k in reversed(range(len(slot))):
            own = n == k
            np.fmax.at(made[slot[k]], at[own], score[own])
            first[at[own]] = k
        made[made == -np.inf] = 0.0
        if starts is not None:
            made = np.maximum(made, starts[first].T)
        best = made.max(axis=0)
        s = key // wide
        order = np.lexsort((-_nine(best), s))  # the key is in order of the candidates
        place = np.arange(len(s)) - np.searchsorted(s[order], s[order])
        kept, place = order[place < most], place[place < most]
        q, c = s[kept] - 1, key[kept] % wide - 1
        out = [values.take(pa.array(x, mask=x < 0)) for values, x in ((queries, q), (ids, c))] + [pa.array(x[kept]) for x in made]
        out += ([] if starts is None else [pa.array(np.bincount(at, minlength=len(key))[kept])]) + [pa.array(best[kept]), pa.array((place + 1).astype(np.int32))]
        table = pa.Table.from_arrays(out, schema.names)
        yield from table.to_batches(max_chunksize=GIVEN)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            b = batch["_b"].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))).tolist() if len(b) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if now != b[lo] and held:
                    yield from ranked(held)
                    held = []
                now = b[lo]
                held.extend(opened(batch["_blob"].slice(lo, hi - lo)))
        if held:
            yield from ranked(held)

    return dealt.mapInArrow(unite, schema)


def with_neighbours(text: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """Text candidates first, then neighbours that are new, with zero scores; ranked anew and capped."""
    new = near.join(text.select("s1", "cid"), ["s1", "cid"], "left_anti").select("s1", "cid", F.lit(1).alias("ann"), F.col("rank").alias("_r"))
    scores = [c for c in text.columns if c.startswith("s_")]
    rows = text.select("s1", "cid", F.lit(0).alias("ann"), F.col("rank").alias("_r"), *scores)
    both = rows.unionByName(new, allowMissingColumns=True).na.fill(0.0, scores)
    order = Window.partitionBy("s1").orderBy("ann", "_r", "cid")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_r")


def with_country_fallback(records: DataFrame) -> DataFrame:
    """Corpus records once more under each S1 country that has no corpus of its own."""
    corpus = records.where("side <> 'S1'")
    bare = records.where("side = 'S1'").select("country").distinct().join(corpus.select("country").distinct(), "country", "left_anti")
    # a row for each country without a corpus
    extra = corpus.drop("country").join(F.broadcast(bare)).select(*records.columns)
    return records.unionByName(extra)
