"""Features of candidate pairs, as named columns in the order of the feature lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import address as ad
from ..functions import fixed
from ..functions import similarity as sm
from ..functions import text as tx
from .packs import opened, pack
from .sparse import _spread

DIGITS = "^[0-9]+$"


#: Queries and corpus records of a block at most, records that make a block, and records that are packed at a time.
QUERIES, CORPUS, LEAST, PACKED = 65_536, 131_072, 256, 65_536
#: Pairs of two blocks that are put in order at a time, and rows of a batch that follows from them.
ORDERED, BATCH = 1 << 18, 10_000
#: Elements of sets that are looked up at a time.
LOOKED_UP = 1 << 20
#: An odd number that spreads the digests of sets.
_MIX = 0x9E3779B97F4A7C15
_KEY = ["_qb", "_cb", "_kind", "_blob"]


def _coded(tables: list[pa.Table], names: list[str]) -> list[pa.Table]:
    """The tables with the named lists of strings as lists of numbers, one for each string of all of them."""
    lists = [t[n].combine_chunks() for t in tables for n in names]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices
    at, out = 0, []
    for x in lists:
        size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), codes.slice(at, int(ends[-1])), mask=x.is_null() if x.null_count else None))
        at += int(ends[-1])
    made = []
    for i, t in enumerate(tables):
        for n, x in zip(names, out[i * len(names) :], strict=False):
            t = t.set_column(t.column_names.index(n), n, x)
        made.append(t)
    return made


class _Bags:
    """Sets of numbers as classes of equal ones: each row's class (-1 for null), and the classes' elements in order."""

    def __init__(self, lists: pa.ListArray) -> None:
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        key = np.unique(np.repeat(np.arange(len(size)), size) << 32 | flat)  # a set has an element once
        row, flat = key >> 32, key & 0xFFFFFFFF
        size = np.bincount(row, minlength=len(size))
        start = np.cumsum(size) - size
        mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ mixed >> np.uint64(32))))
        _, first, own = np.unique(sums[start + size] - sums[start], return_index=True, return_inverse=True)
        same = first[own]
        equal = np.array_equal(size[same], size) and np.array_equal(flat[_spread(start[same], size)], flat)
        if not equal:  # two sets have one digest: each row is a class
            first = own = np.arange(len(size))
        self.of = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, own)
        self.size = size[first]
        self.flat = flat[_spread(start[first], self.size)]
        self.start = np.cumsum(self.size) - self.size
        self.keys = np.repeat(np.arange(len(self.size)), self.size) << 32 | self.flat


def _distinct(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers of at least -1, by j and then i, and which of them each pair is."""
    wide = int(i.max(initial=-1)) + 2
    key, which = np.unique((j.astype(np.int64) + 1) * wide + i + 1, return_inverse=True)
    return key % wide - 1, key // wide - 1, which


def _common(a: _Bags, b: _Bags, i: np.ndarray, j: np.ndarray) -> pa.Array:
    """How many elements the sets of rows i of a and j of b have in common; null if one is null."""
    u, v, which = _distinct(a.of[i], b.of[j])
    missing = (u < 0) | (v < 0)
    size = np.where(missing, 0, a.size[u]) if len(a.size) else np.zeros(len(u), np.int64)
    out, work, at = np.zeros(len(u), np.int64), np.cumsum(size), 0
    while at < len(u) and len(b.keys):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + LOOKED_UP, "right")))
        n = size[at:to]
        key = np.repeat(v[at:to], n) << 32 | a.flat[_spread(a.start[u[at:to]], n)]
        hit = b.keys[np.minimum(np.searchsorted(b.keys, key), len(b.keys) - 1)] == key
        out[at:to] = np.bincount(np.repeat(np.arange(to - at), n), hit, to - at)
        at = to
    return pa.array(out[which], mask=missing[which])


def _compared(a: tuple[np.ndarray, list], b: tuple[np.ndarray, list], i: np.ndarray, j: np.ndarray, names: tuple[str, ...]) -> list[pa.Array]:
    """The named similarities of the strings of rows i of a and j of b."""
    u, v, which = _distinct(a[0][i], b[0][j])
    x, y = ([own[1][k] if k >= 0 else None for k in at.tolist()] for own, at in ((a, u), (b, v)))
    made = sm.score_pairs(x, y, names)
    return [pa.array(made[n][which]) for n in names]


def _tested(a: tuple[np.ndarray, list], b: tuple[np.ndarray, list], i: np.ndarray, j: np.ndarray, test: Callable) -> pa.Array:
    """What a test says of the values of rows i of a and j of b; it gets None for null."""
    u, v, which = _distinct(a[0][i], b[0][j])
    x, y = ([own[1][k] if k >= 0 else None for k in at.tolist()] for own, at in ((a, u), (b, v)))
    return pa.array(np.array([test(p, q) for p, q in zip(x, y, strict=True)], float)[which])


def _dots(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> pa.Array:
    """similarity.dot() of the vectors of rows i of a and j of b, added up in its order; null if one is null or they differ in length."""
    (m, size_m), (n, size_n) = a[1:], b[1:]
    u, v, which = _distinct(a[0][i], b[0][j])
    missing = (u < 0) | (v < 0)
    out = np.zeros(len(u))
    if len(m) and len(n):
        missing |= size_m[u] != size_n[v]
        for d in range(min(m.shape[1], n.shape[1])):
            out += m[u, d] * n[v, d]
    return pa.array(out[which], mask=missing[which])


class _Block:
    """Records of a block by doc; several may share one."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        self.known: dict[str, tuple] = {}
        self.sets: dict[str, _Bags] = {}
        ids = rows["doc"].to_pylist()
        first: dict = {}
        for i, x in enumerate(ids):
            first.setdefault(x, i)
        self.place = {x: k for k, x in enumerate(first)}
        self.start = np.array(list(first.values()), np.int64)
        self.count = np.diff(np.append(self.start, len(ids)))

    def find(self, docs: pa.Array) -> np.ndarray:
        get = self.place.get
        return np.array([get(x, -1) for x in docs.to_pylist()], np.int64)

    def values(self, name: str) -> tuple[np.ndarray, list]:
        """A number for each value of a column, by row, and the values."""
        if name not in self.known:
            own = self.rows[name].combine_chunks().dictionary_encode()
            self.known[name] = own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), own.dictionary.to_pylist()
        return self.known[name]

    def codes(self, name: str) -> np.ndarray:
        return self.values(name)[0]

    def bags(self, name: str) -> _Bags:
        if name not in self.sets:
            self.sets[name] = _Bags(self.rows[name].combine_chunks())
        return self.sets[name]


    def vectors(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each different vector, by row (-1 for null), the vectors, padded with zeros, and their lengths."""
        if name not in self.known:
            own = self.rows[name].combine_chunks()
            size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wide = np.zeros((len(size), int(size.max(initial=0)) + 1))
            flat = own.flatten().to_numpy(zero_copy_only=False)
            wide[np.repeat(np.arange(len(size)), size), _spread(np.zeros(len(size), np.int64), size)] = flat
            wide[:, -1] = size  # vectors of several lengths are different
            _, first, code = np.unique(wide.view(np.dtype((np.void, wide.itemsize * wide.shape[1]))).ravel(), return_index=True, return_inverse=True)
            self.known[name] = np.where(own.is_null().to_numpy(zero_copy_only=False), -1, code), wide[first, :-1], size[first]
        return self.known[name]


def _met(batch: pa.Table, a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the batch, of a and of b that belong together."""
    i, j = a.find(batch["s1"]), b.find(batch["cid"])
    rows = np.flatnonzero((i >= 0) & (j >= 0))
    i, j = i[rows], j[rows]
    n, m = a.count[i], b.count[j]
    each = n * m
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    wide = np.repeat(m, each)
    return np.repeat(rows, each), np.repeat(a.start[i], each) + nth // wide, np.repeat(b.start[j], each) + nth % wide


def paired(
    pairs: DataFrame, records: DataFrame, sets: tuple[str, ...] = (), near: tuple[str, ...] = (),
    common: dict[str, tuple[str, str]] | None = None, strings: dict[str, tuple[str, tuple[str, ...]]] | None = None, hidden: tuple[str, ...] = (),
    tests: dict[str, tuple[str, Callable]] | None = None, dots: dict[str, str] | None = None,
    made_of: tuple[Callable[[dict[str, pa.Array]], list[pa.Array]], T.StructType] | None = None,
) -> DataFrame:
    """Pairs with the columns of both records, a_ for the query's and b_ for the candidate's.

    Wide records are not dealt with every pair. Queries and corpus records go to blocks, each two blocks meet in one
    task, and only the pairs' own columns are dealt to them. Blocks and their pairs are dealt as compressed files.
    ``sets`` are lists of strings that are compared with each other only: they come as lists of numbers.
    Pairs that are equal in the columns ``near`` come one after another, so that kernels over batches see them once.
    ``common`` names columns for how many elements a query's and a candidate's set share, ``strings`` the columns whose
    similarities come as ``<name>_<kernel>``, ``tests`` those of which a function tells a number, ``dots`` vectors
    whose product is wanted: all are made once for each two different values that meet. ``hidden`` columns of the
    records are read for that only. ``made_of``: a function of these columns whose own columns are given on instead.
    """
    common, strings, tests, dots = common or {}, strings or {}, tests or {}, dots or {}
    own = records.where("doc IS NOT NULL").withColumn("_left", (F.col("side") == "S1").cast("int")).where("_left IS NOT NULL")
    count = {r["_left"]: r["count"] for r in own.groupBy("_left").count().collect()}  # two rows
    least = math.isqrt(4 * records.sparkSession.sparkContext.defaultParallelism - 1) + 1  # four tasks a core
    left, right = (max(-(-n // most), min(least, -(-n // LEAST)), 1) for n, most in ((count.get(1, 0), QUERIES), (count.get(0, 0), CORPUS)))
    keep = [c for c in records.columns if c != "doc" and c not in hidden]
    measured = [f"{out}_{n}" for out, (_, kernels) in strings.items() for n in kernels]

    def block(doc: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), doc), n).cast("int")

    dealt = own.withColumn("_block", block("doc", F.when(F.col("_left") == 1, F.lit(left)).otherwise(F.lit(right))))
    packed = dealt.mapInArrow(pack("_left", "_block", PACKED), "_left int, _block int, _blob binary")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("_left") == 1, F.lit(right - 1)).otherwise(F.lit(left - 1))))
    packed = packed.select("_left", "_block", "_blob", every.alias("_other"))
    mine, other = F.col("_block"), F.col("_other")
    queries = F.col("_left") == 1
    blobs = packed.select(F.when(queries, mine).otherwise(other).alias("_qb"), F.when(queries, other).otherwise(mine).alias("_cb"), (1 - F.col("_left")).alias("_kind"), "_blob")
    names = ["cid", "s1", *(c for c in pairs.columns if c not in ("s1", "cid"))]
    known = pairs.where("s1 IS NOT NULL AND cid IS NOT NULL")
    rows = known.select(block("s1", F.lit(left)).alias("_qb"), block("cid", F.lit(right)).alias("_cb"), *names)
    rows = rows.mapInArrow(pack("_qb", "_cb", ORDERED), "_qb int, _cb int, _blob binary").withColumn("_kind", F.lit(2))
    # a partition for each two blocks
    both = rows.unionByName(blobs).repartitionById(left * right, F.col("_qb") * right + F.col("_cb")).sortWithinPartitions("_qb", "_cb", "_kind")

    kinds = {f.name: T.ArrayType(T.IntegerType()) if f.name in sets else f.dataType for f in records.schema}
    schema = T.StructType([T.StructField(n, pairs.schema[n].dataType) for n in names] + [T.StructField(s + c, kinds[c]) for s in ("a_", "b_") for c in keep])
    for own_type, made in ((T.LongType(), common), (T.DoubleType(), [*measured, *tests, *dots])):
        for n in made:
            schema = schema.add(n, own_type)
    coded = [c for c in records.columns if c in sets]
    given = made_of[1] if made_of else schema

    def joined(parts: list[pa.Table], blocks: list[_Block]) -> Iterator[pa.RecordBatch]:
        own_ = pa.concat_tables(parts).combine_chunks()
        at = _met(own_, *blocks)
        if near:
            order = np.lexsort([b.codes(n)[i] for n in reversed(near) for b, i in zip(blocks[::-1], at[:0:-1], strict=True)])
            at = tuple(x[order] for x in at)
        a, b = blocks
        more = [_common(a.bags(x), b.bags(y), *at[1:]) for x, y in common.values()]
        for column, kernels in strings.values():
            more += _compared(a.values(column), b.values(column), *at[1:], kernels)
        more += [_tested(a.values(column), b.values(column), *at[1:], test) for column, test in tests.values()]
        more += [_dots(a.vectors(column), b.vectors(column), *at[1:]) for column in dots.values()]
        for lo in range(0, len(at[0]), BATCH):
            rows_, i, j = (pa.array(x[lo : lo + BATCH]) for x in at)
            made = [own_[n].take(rows_).combine_chunks() for n in names] + [b.rows[n].take(k).combine_chunks() for b, k in zip(blocks, (i, j), strict=True) for n in keep]
            made += [x.slice(lo, BATCH) for x in more]
            if made_of:
                made = made_of[0](dict(zip(schema.names, made, strict=True)))
            yield pa.RecordBatch.from_arrays(made, given.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, blocks, parts = None, ([], []), None, []
        for batch in batches:
            q, c, kind = (batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in _KEY[:3])
            new = (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])
            edges = np.flatnonzero(np.concatenate(([True], new, [True]))).tolist() if len(q) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if at != (q[lo], c[lo]):
                    if parts:
                        yield from joined(parts, blocks)
                    at, held, blocks, parts = (q[lo], c[lo]), ([], []), None, []
                part = batch.slice(lo, hi - lo)
                if kind[lo] < 2:
                    held[kind[lo]].extend(opened(part["_blob"]))
                elif all(held) or blocks:
                    if blocks is None:
                        tables = [pa.concat_tables(h).combine_chunks().sort_by("doc") for h in held]
                        blocks, held = [_Block(t) for t in (_coded(tables, coded) if coded else tables)], ([], [])
                    for own_pairs in opened(part["_blob"]):
                        parts.append(own_pairs)
                        if sum(p.num_rows for p in parts) >= ORDERED:
                            yield from joined(parts, blocks)
                            parts = []
        if parts:
            yield from joined(parts, blocks)

    return both.mapInArrow(meet, given)


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def _jaccard(name: str) -> Column:
    """similarity.jaccard() of two sets from what they have in common and their sizes n_*."""
    shared, (a, b) = F.col(f"x_{name}"), _both(f"n_{name}")
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def _sized(rows: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """With the numbers of different elements of sets."""
    return rows.withColumns({f"n_{c}": F.size(F.array_distinct(c)) for c in sets})


def _sims(df: DataFrame, column: str, out: str, names: tuple[str, ...]) -> DataFrame:
    return df.withColumn(out, sm.string_similarities(*_both(column), names))


def _kept(df: DataFrame) -> list[Column]:
    """What stays beside the features: the pair, the query's country, and a label if there is one."""
    return [F.col("s1"), F.col("cid"), F.col("a_country").alias("country"), *(F.col(c) for c in ("label",) if c in df.columns)]


def _same(x: str | None, y: str | None) -> bool:
    """Equal texts, neither null nor empty."""
    return bool(x) and x == y


def _begun(x: str | None, y: str | None, n: int) -> bool:
    return x is not None and y is not None and min(len(x), len(y)) >= n and x[:n] == y[:n]


def _within(x: str | None, y: str | None) -> bool:
    return x is not None and y is not None and min(len(x), len(y)) >= 5 and (x in y or y in x)


def _tri_state(x: str | None, y: str | None, inside: bool = False) -> float:
    """similarity.tri_state() of two values."""
    if x == "" or y == "":
        return 0.0
    return 1.0 if x is not None and y is not None and (x == y or inside and (x in y or y in x)) else -1.0


#: What dense() asks of the texts of two records: the feature, or whether both have a clean name.
TESTS = {
    "t_clean": ("name_clean", lambda x, y: bool(x) and bool(y)), "name_prefix_match_3": ("name_clean", partial(_begun, n=3)), "name_prefix_match_5": ("name_clean", partial(_begun, n=5)),
    "name_first_word_match": ("first_word", _same), "spaceless_exact_match": ("name_spaceless", _same), "spaceless_containment": ("name_spaceless", _within),
    "house_number_match": ("hn", partial(_tri_state, inside=True)), "hn_exact_clean": ("hn", _same), "postal_code_match": ("pc", _tri_state),
    "city_match": ("city", _same), "state_match": ("state", _same), "legal_suffix_match": ("legal_suffix", _same),
}
#: Columns that only some features read.
_READ = {
    "city_match": "city", "state_match": "state", "legal_suffix_match": "legal_suffix", "phonetic_key_overlap": "phonetic_keys", "name_trigram_jaccard": "name_trigrams",
    "name_bigram_jaccard": "name_bigrams", "addr_trigram_jaccard": "addr_trigrams", "addr_numeric_token_jaccard": "digits",
}
DENSE_SETS = ("name_words", "addr_tokens", "nums", "phonetic_keys", "name_trigrams", "name_bigrams", "addr_trigrams", "digits")


def dense_records(records: DataFrame, names: tuple[str, ...] = fixed.FEATURES_50, name_column: str = "name_norm", addr_column: str = "addr_norm") -> DataFrame:
    """What dense() reads of normalized() records; whatever depends on one record is made here, once."""
    rows = records.withColumn("digits", F.filter("addr_tokens", lambda x: x.rlike(DIGITS)))
    rows = rows.withColumn("name_bigrams", tx.char_ngrams(F.col("name_clean"), 2)).withColumn("addr_trigrams", tx.char_ngrams(F.col(addr_column), 3))
    if "semantic_cosine" in names:
        rows = rows.withColumn("vector_square", sm.dot(F.col("name_vector"), F.col("name_vector")))
    rows = _sized(rows, dense_sets(names)).withColumns({f"size_{c}": F.size(c) for c in ("name_words", "addr_tokens")})
    rows = rows.withColumns({"name_length": F.length(name_column), "addr_length": F.length(addr_column)})
    some = [c for n, c in _READ.items() if n in names and c not in DENSE_SETS] + (["name_vector", "vector_square"] if "semantic_cosine" in names else [])
    every = ["doc", "side", "country", "is_s3", name_column, addr_column, "name_clean", "name_spaceless", "first_word", "hn", "pc"]
    sizes = ["size_name_words", "size_addr_tokens", "name_length", "addr_length", *(f"n_{c}" for c in dense_sets(names))]
    return rows.select(*every, *dense_sets(names), *sizes, *some)


def dense_sets(names: tuple[str, ...] = fixed.FEATURES_50) -> tuple[str, ...]:
    """The sets that the listed features compare."""
    own = {c for n, c in _READ.items() if n in names} | {"name_words", "addr_tokens", "nums"}
    return tuple(c for c in DENSE_SETS if c in own)


def dense_pairs(
    pairs: DataFrame, records: DataFrame, names: tuple[str, ...] = fixed.FEATURES_50, name_column: str = "name_norm", addr_column: str = "addr_norm",
    made_of: tuple[Callable, T.StructType] | None = None,
) -> DataFrame:
    """paired() dense_records() with what their sets share and how alike their strings are."""
    sets = dense_sets(names)
    common = {f"x_{c}": (c, c) for c in sets} | {"x_across": ("name_words", "addr_tokens")}
    strings = {
        "_n": (name_column, ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "jaro_winkler", "levenshtein")),
        "_a": (addr_column, ("ratio", "token_sort_ratio", "token_set_ratio", "levenshtein")), "_c": ("name_clean", ("token_sort_ratio",)),
    }
    rows = dense_records(records, names, name_column, addr_column)
    tests = {f"t_{n.removeprefix('t_')}": test for n, test in TESTS.items() if n in names or n == "t_clean"}
    dots = {"x_vector": "name_vector"} if "semantic_cosine" in names else {}
    read = {c for c, _ in TESTS.values() if c in rows.columns} | {*dots.values(), name_column, addr_column, *sets, "side"}
    return paired(pairs, rows, sets, (name_column, addr_column), common, strings, tuple(read), tests, dots, made_of)


def dense(pairs: DataFrame, records: DataFrame, names: tuple[str, ...] = fixed.FEATURES_50, name_column: str = "name_norm", addr_column: str = "addr_norm") -> DataFrame:
    """s1, cid, country, a label if pairs have one, and the listed features (32, 35, 50 or 51 of them) of pairs that have slots s_* and rank.

    All are made where the pairs meet: expressions of so many columns are one method, too long for Java to compile.
    """
    kept = ["s1", "cid", "country", *(c for c in ("label",) if c in pairs.columns)]
    kinds = {"country": records.schema["country"].dataType} | {c: pairs.schema[c].dataType for c in kept if c != "country"}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])

    def made_of(columns: dict[str, pa.Array]) -> list[pa.Array]:
        made = dense_columns({n: x.to_numpy(zero_copy_only=False).astype(float) for n, x in columns.items() if pa.types.is_floating(x.type) or pa.types.is_integer(x.type)}, names)
        return [columns["a_country" if c == "country" else c] for c in kept] + [pa.array(made[n], from_pandas=True) for n in names]

    return dense_pairs(pairs, records, names, name_column, addr_column, (made_of, schema))


def dense_columns(df: dict[str, np.ndarray], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The listed features from the numbers that dense_pairs() gives, NaN for null."""
    none = np.zeros(len(df["rank"]))

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a / b, zero where b is not positive."""
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

    def jaccard(name: str) -> np.ndarray:
        return over(df[f"x_{name}"], df[f"a_n_{name}"] + df[f"b_n_{name}"] - df[f"x_{name}"])

    def containment(name: str) -> np.ndarray:
        return over(df[f"x_{name}"], np.fmin(df[f"a_size_{name}"], df[f"b_size_{name}"]))

    def number(flags: np.ndarray) -> np.ndarray:
        return flags.astype(float)

    n1, n2, a1, a2, w1, w2 = (df[f"{side}_{c}"] for c in ("name_length", "addr_length", "size_name_words") for side in "ab")
    common, union = df["x_name_words"], df["a_n_name_words"] + df["b_n_name_words"] - df["x_name_words"]
    slots = [df[f"s_{c}"] for c in ("word", "addr", "char", "sorted")]
    fired = sum(number(s > 0) for s in slots)
    every = [df.get(f"s_{c}", none) for c in ("word", "addr", "char", "sorted", "five", "phonetic", "prefix")]
    made = {
        "name_ratio": lambda: df["_n_ratio"],
        "name_token_sort_ratio": lambda: df["_n_token_sort_ratio"],
        "name_token_set_ratio": lambda: df["_n_token_set_ratio"],
        "name_partial_ratio": lambda: df["_n_partial_ratio"],
        "name_levenshtein_sim": lambda: df["_n_levenshtein"],
        "name_jaro_winkler": lambda: df["_n_jaro_winkler"],
        "name_word_jaccard": lambda: jaccard("name_words"),
        "name_containment": lambda: containment("name_words"),
        "name_len_ratio": lambda: over(np.fmin(n1, n2), np.fmax(n1, n2)),
        "name_word_diff": lambda: np.abs(w1 - w2),
        "name_clean_ratio": lambda: np.where(df["t_clean"] > 0, df["_c_token_sort_ratio"], df["_n_token_sort_ratio"]),
        "addr_ratio": lambda: df["_a_ratio"],
        "addr_token_sort_ratio": lambda: df["_a_token_sort_ratio"],
        "addr_token_set_ratio": lambda: df["_a_token_set_ratio"],
        "addr_levenshtein_sim": lambda: df["_a_levenshtein"],
        "addr_word_jaccard": lambda: jaccard("addr_tokens"),
        "addr_containment": lambda: containment("addr_tokens"),
        "numeric_overlap": lambda: jaccard("nums"),
        "both_addr_missing": lambda: number((a1 == 0) & (a2 == 0)),
        "one_addr_missing": lambda: number((a1 == 0) != (a2 == 0)),
        "name_in_cand_addr": lambda: over(df["x_across"], w1),
        "tfidf_word_score": lambda: slots[0],
        "addr_jaccard_score": lambda: slots[1],
        "tfidf_char_score": lambda: slots[2],
        "tfidf_sorted_score": lambda: slots[3],
        "max_channel_score": lambda: np.max(slots, axis=0),
        "mean_channel_score": lambda: over(sum(slots[1:], slots[0]), fired),
        "cand_rank_inv": lambda: 1.0 / df["rank"],
        "is_source3": lambda: df["b_is_s3"],
        "name_bigram_jaccard": lambda: jaccard("name_bigrams"),
        "name_trigram_jaccard": lambda: jaccard("name_trigrams"),
        "addr_trigram_jaccard": lambda: jaccard("addr_trigrams"),
        "addr_numeric_token_jaccard": lambda: jaccard("digits"),
        "name_common_word_count": lambda: common,
        "addr_common_word_count": lambda: df["x_addr_tokens"],
        "name_unique_word_ratio": lambda: over(union - common, union),
        "combined_name_addr_score": lambda: 0.6 * df["_n_token_sort_ratio"] + 0.4 * jaccard("addr_tokens"),
        "phonetic_key_overlap": lambda: jaccard("phonetic_keys"),
        "n_blocking_channels_hit": lambda: sum(number(s > 0) for s in every),
        "semantic_cosine": lambda: np.clip(over(df["x_vector"], np.sqrt(df["a_vector_square"] * df["b_vector_square"])), 0.0, 1.0),
    }
    made |= {n: lambda n=n: df[f"t_{n}"] for n in TESTS if n != "t_clean"}
    out = {n: made[n]() for n in names}
    if "semantic_cosine" in out:
        out["semantic_cosine"] = np.nan_to_num(out["semantic_cosine"])
    return out


SETS_16 = ("words", "tokens")


def records_16(records: DataFrame) -> DataFrame:
    """What features_16() reads of basic() records."""
    name, addr, raw = F.col("name_norm"), F.col("addr_norm"), F.col("addr_raw")
    made = {
        "words": tx.word_set(name), "tokens": tx.word_set(addr), "first": tx.first_word(name),
        "hn": ad.house_number_any(raw), "pc": ad.postal_code_any(raw),
    }
    return records.select("doc", "side", "country", "name_norm", "addr_norm", *(c.alias(n) for n, c in made.items()))


def features_16(df: DataFrame) -> DataFrame:
    """Set features only. ``df``: paired() records_16() with s_word, s_addr, s_char and rank."""
    n1, n2 = _both("words")
    t1, t2 = _both("tokens")
    f1, f2 = _both("first")
    made = {
        "tfidf_word": F.col("s_word"),
        "addr_jaccard": F.col("s_addr"),
        "tfidf_char": F.col("s_char"),
        "name_word_jaccard": sm.jaccard(n1, n2),
        "name_containment": sm.containment(n1, n2),
        "name_first_word": sm.flag((f1 != "") & (f1 == f2)),
        "addr_word_jaccard": sm.jaccard(t1, t2),
        "addr_containment": sm.containment(t1, t2),
        "house_match": sm.tri_state(*_both("hn")),
        "postal_match": sm.tri_state(*_both("pc")),
        "both_addr_missing": sm.flag((F.size(t1) == 0) & (F.size(t2) == 0)),
        "one_addr_missing": sm.flag((F.size(t1) == 0) != (F.size(t2) == 0)),
        "name_len_ratio": sm.length_ratio(*_both("name_norm")),
        "addr_len_ratio": sm.length_ratio(*_both("addr_norm")),
        "is_s3": (F.col("b_side") == "S3").cast("double"),
        "cand_rank": F.col("rank").cast("double"),
    }
    return df.select(*_kept(df), *(made[n].alias(n) for n in fixed.FEATURES_16))


SETS_18 = ("words", "tokens")


def records_18(records: DataFrame) -> DataFrame:
    """What features_18() reads of basic() records."""
    rows = records.withColumn("deep", tx.DEEP.col("name_raw"))
    name, addr, raw = F.col("deep"), F.col("addr_norm"), F.col("addr_raw")
    made = {
        "words": tx.word_set(name), "tokens": tx.word_set(addr), "first": tx.first_word(name), "script": tx.script(F.col("name_raw")),
        "hn": ad.house_number_leading(raw), "pc": ad.postal_code_five_first(raw),
    }
    return rows.select("doc", "side", "country", "deep", "addr_norm", *(c.alias(n) for n, c in made.items()))


def features_18(df: DataFrame) -> DataFrame:
    """The first reranker's features. ``df``: paired() records_18() with the blocking score."""
    deep = _sims(_sims(df, "deep", "_n", ("ratio",)), "addr_norm", "_a", ("ratio",))
    n1, n2 = _both("deep")
    a1, a2 = _both("addr_norm")
    (w1, w2), (t1, t2), (f1, f2) = _both("words"), _both("tokens"), _both("first")

    def zero_if_empty(x: Column, a: Column, b: Column) -> Column:
        return F.when((F.size(a) > 0) & (F.size(b) > 0), x).otherwise(F.lit(0.0))

    made = {
        "tfidf_composite": F.col("score"),
        "name_exact": sm.flag((n1 == n2) & (n1 != "")),
        "name_seqmatch": F.col("_n.ratio"),
        "name_jaccard": zero_if_empty(sm.jaccard(w1, w2), w1, w2),
        "name_containment": sm.containment(w1, w2),
        "name_len_ratio": F.when((n1 != "") & (n2 != ""), sm.length_ratio(n1, n2)).otherwise(F.lit(0.0)),
        "name_word_diff": F.abs(F.size(w1) - F.size(w2)).cast("double"),
        "name_first_word_match": sm.flag((F.length(f1) > 1) & (f1 == f2)),
        "script_mismatch": sm.flag(F.col("a_script") != F.col("b_script")),
        "addr_exact": sm.flag((a1 == a2) & (a1 != "")),
        "addr_jaccard": zero_if_empty(sm.jaccard(t1, t2), t1, t2),
        "addr_seqmatch": F.col("_a.ratio"),
        "postal_match": sm.tri_state(*_both("pc")),
        "house_num_match": sm.tri_state(*_both("hn")),
        "both_addr_missing": sm.flag((a1 == "") & (a2 == "")),
        "one_addr_missing": sm.flag((a1 == "") != (a2 == "")),
        "name_in_addr_overlap": F.when((F.size(w1) > 0) & (F.size(t2) > 0), F.size(F.array_intersect(w1, t2)) / F.size(w1)).otherwise(F.lit(0.0)),
        "addr_containment": sm.containment(t1, t2),
    }
    return deep.select(*_kept(df), *(made[n].alias(n) for n in fixed.FEATURES_18))


RESCORE_SETS = ("names", "tokens", "digits", "bigrams", "trigrams", "addr_trigrams")


def rescore_records(records: DataFrame) -> DataFrame:
    """What rescore_35() reads of basic() records."""
    rows = records.withColumn("rn", F.trim("name_raw")).withColumn("ra", F.trim("addr_raw"))
    rows = rows.withColumn("rc", tx.RESCORE_NAME.col("rn")).withColumn("hn", ad.house_number_whole(F.col("ra")))
    rows = rows.withColumn("pc", ad.postal_code_by_country(F.col("ra"), F.col("country"), F.col("hn")))
    for f, o in (("rn", "wn"), ("ra", "wa")):
        rows = rows.withColumn(o, F.regexp_extract_all(F.lower(F.col(f)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    made = {
        "low_name": F.lower("rn"), "low_addr": F.lower("ra"), "plain": F.regexp_replace(F.lower("rn"), "[^a-zA-Z0-9]", ""),
        "names": F.array_distinct("wn"), "words": F.size("wn"), "first": F.get("wn", F.lit(0)), "tokens": F.array_distinct("wa"),
        "digits": F.array_distinct(F.filter("wa", lambda w: w.rlike(DIGITS))),
        "bigrams": tx.char_ngrams(F.col("rc"), 2), "trigrams": tx.char_ngrams(F.col("rc"), 3), "addr_trigrams": tx.char_ngrams(F.lower("ra"), 3),
    }
    return _sized(rows.select("doc", "side", "country", "rn", "ra", "rc", "hn", "pc", *(c.alias(n) for n, c in made.items())), RESCORE_SETS)


def rescore_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """paired() rescore_records() with what their sets share and how alike their strings are."""
    strings = {
        "_n": ("rn", ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "jaro_winkler", "levenshtein")),
        "_a": ("ra", ("ratio", "token_sort_ratio", "token_set_ratio", "levenshtein")), "_c": ("rc", ("ratio",)),
    }
    return paired(pairs, rescore_records(records), RESCORE_SETS, ("rn", "ra"), {f"x_{c}": (c, c) for c in RESCORE_SETS}, strings, RESCORE_SETS)


def rescore_35(df: DataFrame) -> DataFrame:
    """The rescorer's features from raw fields. ``df``: rescore_pairs() with rank."""
    n1, n2 = _both("rn")
    a1, a2 = _both("ra")
    c1, c2 = _both("rc")
    p1, p2 = _both("plain")
    named, addressed = (n1 != "") & (n2 != ""), (a1 != "") & (a2 != "")
    made = {
        "name_ratio": F.col("_n_ratio"),
        "name_token_sort_ratio": F.col("_n_token_sort_ratio"),
        "name_token_set_ratio": F.col("_n_token_set_ratio"),
        "name_partial_ratio": F.col("_n_partial_ratio"),
        "name_levenshtein_sim": F.col("_n_levenshtein"),
        "name_jaro_winkler": F.col("_n_jaro_winkler"),
        "name_word_jaccard": _jaccard("names"),
        "name_containment": sm.flag(named & (n1.contains(n2) | n2.contains(n1))),
        "name_len_ratio": sm.length_ratio(n1, n2),
        "name_word_diff": F.abs(F.col("a_words") - F.col("b_words")).cast("double"),
        "name_first_word_match": sm.flag(F.coalesce(F.col("a_first") == F.col("b_first"), F.lit(False))),
        "name_clean_ratio": F.when(named & (c1 == "") & (c2 == ""), F.lit(1.0)).otherwise(F.col("_c_ratio")),
        "addr_ratio": F.col("_a_ratio"),
        "addr_token_sort_ratio": F.col("_a_token_sort_ratio"),
        "addr_token_set_ratio": F.col("_a_token_set_ratio"),
        "addr_levenshtein_sim": F.col("_a_levenshtein"),
        "addr_word_jaccard": F.when(addressed, _jaccard("tokens")).otherwise(F.lit(0.0)),
        "addr_containment": sm.flag(addressed & (a1.contains(a2) | a2.contains(a1))),
        "house_number_match": sm.tri_state(*_both("hn")),
        "postal_code_match": sm.tri_state(*_both("pc")),
        "numeric_overlap": _jaccard("digits"),
        "both_addr_missing": sm.flag((a1 == "") & (a2 == "")),
        "one_addr_missing": sm.flag((a1 == "") != (a2 == "")),
        "name_in_cand_addr": sm.flag((n1 != "") & (a2 != "") & F.col("b_low_addr").contains(F.col("a_low_name"))),
        "name_bigram_jaccard": _jaccard("bigrams"),
        "name_trigram_jaccard": _jaccard("trigrams"),
        "addr_trigram_jaccard": _jaccard("addr_trigrams"),
        "city_match": F.lit(0.0),
        "state_match": F.lit(0.0),
        "name_prefix_match_3": sm.flag((c1 != "") & (F.substring(c1, 1, 3) == F.substring(c2, 1, 3))),
        "name_prefix_match_5": sm.flag((c1 != "") & (F.substring(c1, 1, 5) == F.substring(c2, 1, 5))),
        "spaceless_exact_match": sm.flag((p1 != "") & (p1 == p2)),
        "spaceless_containment": sm.flag((p1 != "") & (p2 != "") & (p1.contains(p2) | p2.contains(p1))),
        "cand_rank_inv": F.lit(1.0) / F.greatest(F.col("rank"), F.lit(1)),
        "is_source3": (F.col("b_side") == "S3").cast("double"),
    }
    return df.select(*_kept(df), *(made[n].cast("double").alias(n) for n in fixed.FEATURES_RESCORE))
