"""Benchmark decontamination with SimHash over windows of an item's size.

An item of n words is held against each window of n words of a document; a document of
fewer words is one window, whole. A window's SimHash comes from running sums of its shingles' bits. Items' fingerprints stand in a
multi-index: 64 bits in BLOCKS blocks; two fingerprints that differ in at most RADIUS bits
differ in at most RADIUS // BLOCKS bits of some block, so the union of the blocks' near
values holds every item within the radius. What comes out is verified by the exact weighted
Jaccard similarity of word shingles (five words, repeats counted).

At similarity 0.8 two fingerprints differ in about ten bits of 64; RADIUS 23 leaves out less
than one such pair in a hundred thousand. Windows without a single shingle of an item have
similarity zero and are not built. A document that is one short window is held against items without
fingerprints, where enough of its shingles are known.

Items are the stated query set: they are read in blocks of bounded size, each block is
broadcast, and all documents pass by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 23
WIDTH = 64 // BLOCKS
#: Pairs of windows and items that are looked at at a time.
CELLS = 1 << 22
#: Text bytes of a block of items: what is broadcast at once.
ITEM_BYTES = 16 << 20
WORD = re.compile(r"\w+")
#: Windows whose bits are summed at a time.
SLICE = 1 << 14
U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w) for w in words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, in order."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ h[k : k + n]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    return out ^ (out >> U(29))


def bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def window_fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each ``size`` shingles in a row: a bit is 1 if set in over half."""
    ones = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(h), axis=0, dtype=np.int32)))
    over = (ones[size:] - ones[:-size]) * 2 > size
    return np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater counts of each shingle."""
    keys, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


class MultiIndex:
    """Fingerprints by the values of their blocks.

    A block's values are few (2 ** WIDTH), so which of them are near is a fixed table; a search looks up each
    window's near values in each block. Pairs are looked at CELLS at a time, however many items there are.
    """

    def __init__(self, fps: np.ndarray, radius: int = RADIUS) -> None:
        self.fps, self.radius = fps, radius
        values = np.arange(1 << WIDTH, dtype=np.uint64)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius // BLOCKS
        # the items near each value of a block, kept where that is a small table, else taken when asked for
        blocks = [self._block(fps, b) for b in range(BLOCKS)]
        small = len(fps) * BLOCKS << WIDTH <= CELLS
        self.tables = [near[:, own] for own in blocks] if small else [(near, own) for own in blocks]
        self.rows = max(1, CELLS // max(len(fps), 1))

    @staticmethod
    def _block(fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> U(WIDTH * b) & U((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, fps: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (query, item) within the radius."""
        for at in range(0, len(fps), self.rows):
            own = fps[at : at + self.rows]
            near = np.zeros((len(own), len(self.fps)), bool)
            for b, table in enumerate(self.tables):
                value = self._block(own, b)
                near |= table[value] if isinstance(table, np.ndarray) else table[0][value][:, table[1]]
            q, i = np.nonzero(near)
            within = np.bitwise_count(own[q] ^ self.fps[i]) <= self.radius
            yield from zip((q[within] + at).tolist(), i[within].tolist(), strict=True)


class Items:
    """A block of benchmark items, by the number of their words."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> None:
        self.shingle, self.similarity = shingle, similarity
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            h = word_hashes(words_of(text))
            if len(h):
                by_size.setdefault(len(h), []).append((item, shingle_hashes(h, min(shingle, len(h)))))
        self.groups = []  # (words, shingle size, ids, shingles of each, index)
        known: dict[int, list[np.ndarray]] = {}
        for n, own in sorted(by_size.items()):
            size = min(shingle, n)
            fps = np.concatenate([window_fingerprints(s, len(s)) for _, s in own])
            self.groups.append((n, size, [i for i, _ in own], [s for _, s in own], MultiIndex(fps)))
            known.setdefault(size, []).extend(s for _, s in own)
        self.known = {size: np.unique(np.concatenate(s)) for size, s in known.items()}
        self.filters = {}
        for size, s in self.known.items():
            self.filters[size] = np.zeros(1 << 16, bool)
            self.filters[size][(s >> U(48)).astype(np.int64)] = True

    def _hits(self, s: np.ndarray, size: int) -> np.ndarray:
        at = np.flatnonzero(self.filters[size][(s >> U(48)).astype(np.int64)])
        known = self.known[size]
        return at[known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]]

    def leaks(self, text: str | None) -> dict[int, tuple[float, int]]:
        """For each item in a text the greatest similarity, and the first word of its first such window."""
        words = words_of(text)
        h = word_hashes(words)
        out: dict[int, tuple[float, int]] = {}
        shingles = {size: shingle_hashes(h, size) for size in self.known if len(h) >= size}
        hits = {size: self._hits(s, size) for size, s in shingles.items()}
        for n, size, ids, own, index in self.groups:
            if size not in shingles or not len(hits[size]):
                continue
            s, m = shingles[size], n - size + 1
            if n > len(words):
                # the union has m shingles at least, and what is shared is among the hits
                if len(hits[size]) >= self.similarity * m:
                    for item, known in zip(ids, own, strict=True):
                        likeness = weighted_jaccard(s, known)
                        if likeness >= self.similarity and likeness > out.get(item, (0.0, 0))[0]:
                            out[item] = (likeness, 0)
                continue
            # windows that hold a hit, as stretches of starts
            first, last = np.maximum(hits[size] - m + 1, 0), np.minimum(hits[size], len(s) - m)
            keep = first <= last
            depth = np.zeros(len(s) + 2, np.int32)
            np.add.at(depth, first[keep], 1)
            np.add.at(depth, last[keep] + 1, -1)
            inside = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(depth) > 0, [False])).astype(np.int8)))
            for a, b in zip(inside[::2].tolist(), inside[1::2].tolist(), strict=True):
                for c in range(a, b, SLICE):
                    d = min(c + SLICE, b)
                    fps = window_fingerprints(s[c : d + m - 1], m)
                    for q, i in index.search(fps):
                        w = c + q
                        # what is shared is among the hits, and the union has m shingles at least
                        if np.searchsorted(hits[size], w + m) - np.searchsorted(hits[size], w) < self.similarity * m - 1e-9:
                            continue
                        likeness = weighted_jaccard(s[w : w + m], own[i])
                        if likeness >= self.similarity and likeness > out.get(ids[i], (0.0, 0))[0]:
                            out[ids[i]] = (likeness, w)
        return out


@lru_cache(4)
def _block(items: tuple[tuple[int, str], ...], shingle: int, similarity: float) -> Items:
    return Items(list(items), shingle, similarity)


def item_blocks(items: DataFrame, most: int = ITEM_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items with an id and text, in blocks of at most ``most`` bytes of text (an item alone may have more)."""
    held, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield tuple(held)
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield tuple(held)


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity, start)`` for each document that holds a window like an item.

    A document with fewer words than an item is one window, as long as it holds a shingle of the item's size.
    similarity is the greatest over the item's windows, start the first word (from 0) of the first
    window that reaches it. Items with fewer words than a shingle are held whole; items without
    words leak nowhere. Null ids and texts of items are left out; null texts of documents are
    empty; a document without an id is left out. Rows that share an id count as one document.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, start long"
    found = spark.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool = _block(shared.value, shingle, similarity)
            for b in slices(batches):
                got = [(d, i, s, w) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (s, w) in tool.leaks(t).items()]
                cols = list(zip(*got, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start"]
                )

        found = found.unionByName(rows.mapInArrow(run, schema))
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", "b.start")


def drop_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no window like an item, as they are."""
    out = docs
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tool = _block(shared.value, shingle, similarity)
            for b in slices(batches):
                clean = [not tool.leaks(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items by find_leaks(): null texts are empty, null ids left out, extra columns not read."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
