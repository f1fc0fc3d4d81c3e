"""SimHash near-duplicates found with BK-trees.

A BK-tree keeps, for each node, its children by their whole-number Hamming distance to
it; by the triangle inequality a search of radius r follows only edges d-r .. d+r.

One tree over all fingerprints would have to pass through the driver, so trees are made
of shards, and a shard's tree goes to the searches of its own shard through a shuffle:

* ``linked``: all pairs of fingerprints within the radius. The 64 bits are cut in
  radius + 1 blocks; two fingerprints within the radius agree in one block at least, so
  the shards are the values of blocks. A shard that grows too large is cut again by the
  blocks of the bits that are left, and what is still too large is dealt as pairs of
  chunks. No pair within the radius is lost on the way.
* ``near_duplicates``: documents whose sets of word shingles have a Jaccard similarity
  of at least ``similarity``; fingerprints are of the sets, too, and four times as wide. Distances are then too
  large for blocks, so shards are bands: two minima of hash orders over a document's shingles. A pair at
  similarity s meets in none of k bands with probability (1 - s ** 2) ** k. The trees propose, and exact
  similarity of the shingles decides, for all pairs that a proposal may stand for.

Searches give spanning links (a union-find in each task), never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, materialize, pair_blocks, read_table, scratch, slices, sorted_groups
from .components import connected_components

#: Most fingerprints of one tree.
TREE = 4096
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 16
SEED = 42


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; A-Z is lower-cased.

    Words are runs without white space; shingles are joined by one space. With fewer words
    than ``size`` the whole sequence is the one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row; null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [signed(fingerprint(shingle_hashes(t, size))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> None:
        """Equal keys are kept once."""
        keys, children = self.keys, self.children
        if not keys:
            keys.append(key)
            children.append({})
            return
        at = 0
        while d := (keys[at] ^ key).bit_count():
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = len(keys)
                keys.append(key)
                children.append({})
                return
            at = nxt

    def search(self, key: int, radius: int) -> list[int]:
        """Keys within the radius, through edges of distance d - radius to d + radius only."""
        found: list[int] = []
        keys, children = self.keys, self.children
        stack = [0] if keys else []
        while stack:
            at = stack.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                found.append(keys[at])
            if own := children[at]:
                if len(own) <= 2 * radius + 1:
                    stack.extend([c for e, c in own.items() if d - radius <= e <= d + radius])
                else:
                    stack.extend([own[e] for e in range(d - radius, d + radius + 1) if e in own])
        return found


def _bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _cut(start: int, width: int, parts: int) -> list[tuple[int, int]]:
    edges = [start + width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def block_shards(classes: DataFrame, radius: int, cap: int) -> DataFrame:
    """Rows of ``classes`` (with a column fp) by the ``shard`` that each meets its neighbours in."""
    blocks = _cut(0, 64, radius + 1)
    fp = F.col("fp")
    firsts = F.array(*[F.struct(F.lit(k).alias("k"), _bits(fp, s, w).alias("v")) for k, (s, w) in enumerate(blocks)])
    first = classes.withColumn("_b", F.explode(firsts)).withColumn("_shard", F.xxhash64("_b.k", "_b.v"))
    counts = first.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = first.join(counts, "_shard")
    deeper = F.lit(None)
    for k, (start, width) in enumerate(blocks):
        # the other bits, moved so that they stand together, are cut in radius + 1 blocks again; shifts stay below 64
        left = _bits(fp, 0, start) if start else F.lit(0).cast("long")
        if start + width < 64:
            left = F.shiftrightunsigned(fp, start + width).bitwiseOR(F.shiftleft(left, 64 - start - width))
        subs = [F.xxhash64(F.col("_shard"), F.lit(m), _bits(left, s, w)) for m, (s, w) in enumerate(_cut(0, 64 - width, radius + 1))]
        deeper = F.when(F.col("_b.k") == k, F.array(*subs)).otherwise(deeper)
    shard = F.explode(F.when(F.col("_n") <= cap, F.array("_shard")).otherwise(deeper))
    return first.withColumn("shard", shard).drop("_b", "_shard", "_n")


def search_shards(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links ``(a, b)`` of ids whose fingerprints lie within the radius in a shard.

    ``rows`` has shard, fp (a long) and id; several ids may have one fingerprint.
    """
    return search_dealt(pair_blocks(rows, "shard", "fp", TREE), radius)


def search_dealt(dealt: DataFrame, radius: int) -> DataFrame:
    """search_shards() of rows that pair_blocks() dealt; fp is a long, or bytes of any length."""
    dealt = dealt.select("shard", "i", "j", "side", "fp", "id")
    keys = ["shard", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, keys):
            if len(g["fp"]) < 2:
                continue
            i, j = int(g["i"][0]), int(g["j"][0])
            wide = g["fp"].dtype == object
            fps = [int.from_bytes(x, "big") for x in g["fp"]] if wide else g["fp"].view(np.uint64).tolist()
            forest, owner = Forest(), {}
            for f, x in zip(fps, g["id"].tolist(), strict=True):
                forest.union(x, owner.setdefault(f, x))
            tree = BKTree()
            if i == j:
                for f, x in owner.items():
                    for near in tree.search(f, radius):
                        forest.union(x, owner[near])
                    tree.add(f)
            else:
                sides = dict(zip(fps, g["side"].tolist(), strict=True))
                for f in owner:
                    if sides[f] == i:
                        tree.add(f)
                for f, x in owner.items():
                    if sides[f] == j:
                        for near in tree.search(f, radius):
                            forest.union(x, owner[near])
            a, b = forest.links()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def linked(fps: DataFrame, radius: int = 3, cap: int = TREE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for rows ``(doc_id, fp)``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer, copies included;
    component_id is the smallest doc_id reachable, the row's own included. Copies meet as
    one class before any search. A null doc_id keeps its row and gets its class's component
    (null if no row of it has an id); null fingerprints never occur in fingerprints().
    """
    with scratch(fps.sparkSession):
        fps = materialize(fps, "fps")
        classes = fps.groupBy("fp").agg(F.min("doc_id").alias("cls"))
        shards = block_shards(classes.where("cls is not null").withColumnRenamed("cls", "id"), radius, cap)
        # materialised, as the rounds would else search again
        links = materialize(search_shards(shards, radius).distinct(), "bklinks")
        groups = connected_components(links)
        named = classes.join(groups, classes.cls == groups.node, "left").select(
            F.col("fp").alias("_fp"), F.coalesce("component", "cls").alias("component_id")
        )
        named = materialize(named, "named")  # as a table it is dealt for the join alone, and AQE can split many copies' rows
        return materialize(fps.join(named, fps.fp == named._fp).drop("_fp"), "linked", keep=True)


#: Words of 64 bits of a wide fingerprint, and the Hamming radius of proposals. At similarity 0.8 a bit of two
#: fingerprints differs with a chance of 0.1875 at most (four shingles of five), 0.152 in long texts: over
#: 84 bits of 256 differ in 2.7e-8 of pairs at worst; of pairs without a common shingle 2e-8 are that near.
WORDS, WIDE = 4, 84
#: Bands of two hash orders: a pair at similarity 0.8 shares none of 14 with a chance of 0.36 ** 14 = 6e-7.
BANDS = 14
#: Documents of one task that compares shingles.
VERIFY = 256
_DRAW = np.random.default_rng(20240203)
_MULTIPLIERS = _DRAW.integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)
_WORD_MULTIPLIERS = _DRAW.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29))) * by
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    return b"".join(fingerprint(_mixed(hashes, m)).to_bytes(8, "big") for m in _WORD_MULTIPLIERS)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS values, each of the least hashes in two orders; none without hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[None, at : at + (1 << 12)] * _MULTIPLIERS[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    return (_mixed(least[:BANDS], _MULTIPLIERS[0]) + least[BANDS:] * _MULTIPLIERS[:BANDS]).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the digest (d1, d2) of the words, wide fingerprint and bands of the distinct shingles of each row with an id."""
    names = ["doc_id", "d1", "d2", "fp", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests, fps, own = [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, size))
                digests.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())))
                fps.append(wide_fingerprint(h))
                own.append(bands(h).tolist())
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(fps, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, d1 long, d2 long, fp binary, bands array<long>")


def _compare(dealt: DataFrame, similarity: float) -> DataFrame:
    """Spanning links ``(a, b)`` of the rows (cluster, i, j, cls, comp, shingles) of a group; equal comps are linked already."""

    def links(table: pa.Table) -> pa.Table:
        cls = table["cls"].to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in table["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        # the members that hold a shingle, shingle by shingle
        terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
        held = np.repeat(np.arange(len(sets)), sizes)[np.argsort(terms, kind="stable")]
        counts = np.bincount(terms)
        firsts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
        group = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
        forest = Forest()
        for x in range(len(sets)):
            lo, hi = np.minimum(sizes[x + 1 :], sizes[x]), np.maximum(sizes[x + 1 :], sizes[x])
            near = np.flatnonzero((lo >= similarity * hi) & (group[x + 1 :] != group[x])) + x + 1
            if not len(near):
                continue
            own = terms[ends[x] - sizes[x] : ends[x]]
            own = own[counts[own] > 1]
            at = np.repeat(firsts[own] - np.cumsum(counts[own]) + counts[own], counts[own]) + np.arange(counts[own].sum())
            both = np.bincount(held[at], minlength=len(sets))[near]
            for y in near[both >= similarity * (sizes[x] + sizes[near] - both)].tolist():
                forest.union(int(cls[x]), int(cls[y]))
                group[group == group[y]] = group[x]
        a, b = forest.links()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = dealt.select("cluster", "i", "j", "cls", "comp", "shingles")
    return rows.groupBy("cluster", "i", "j").applyInArrow(links, "a long, b long")


def _chunk(of: str) -> Column:
    """The chunk of about VERIFY members that a member of a group of so many falls in."""
    return F.pmod(F.xxhash64(F.lit(7), "cls"), F.greatest(F.ceil(F.col(of) / F.lit(VERIFY)), F.lit(1))).cast("int")


def _named(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with ``comp``, the component they are known to be in."""
    return members.join(groups, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")


def _rest(members: DataFrame) -> DataFrame:
    """Groups in which each pair of members (cluster, cls, comp) of different comps meets.

    The largest component of a cluster is cut in chunks that meet those of the others, never each other:
    the rows sent are its members times the chunks of the others, which are few where most are linked.
    """
    parts = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total")).where("top.n < total")
    own = members.join(per, "cluster").withColumn("major", F.col("comp") == F.col("top.comp"))
    own = own.withColumn("_many", F.col("top.n")).withColumn("_few", F.col("total") - F.col("top.n"))
    few, many = F.ceil(F.col("_few") / VERIFY).cast("int"), F.ceil(F.col("_many") / VERIFY).cast("int")
    side = F.when(F.col("major"), -1 - _chunk("_many")).otherwise(_chunk("_few"))
    others = F.when(F.col("major"), F.sequence(F.lit(0), few - 1)).otherwise(F.sequence(-many, few - 1))
    own = own.withColumn("side", side).withColumn("_other", F.explode(others))
    return own.select("cluster", "cls", "comp", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"))


def _verified(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Components ``(node, component)`` of members (cluster, cls) whose texts (doc_id, text) are as similar as that.

    Chunks of a cluster are compared first, each member once. Of clusters of several chunks, one member of each
    component that is found meets the others', and what is then still apart meets all members of other components.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # dealt before the texts join, so a large cluster's texts never move by its key
    dealt = members.join(sizes, "cluster").withColumn("i", _chunk("n"))
    full = dealt.join(texts, F.col("cls") == F.col("doc_id")).select("cluster", "i", "n", "cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [np.unique(shingle_hashes(t, size)).astype("<u8").tobytes() for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own, pa.binary())], ["cluster", "i", "n", "cls", "shingles"])

    own = materialize(full.mapInArrow(sets, "cluster long, i int, n long, cls long, shingles binary"), "sets")
    links = materialize(_compare(own.select("*", F.col("i").alias("j"), F.col("cls").alias("comp")), similarity), "verified")
    groups = connected_components(links)
    large = own.where(F.col("n") > VERIFY)
    if large.select("cls").isEmpty():
        return groups
    shingles = large.select("cls", "shingles")
    first = _named(large.select("cluster", "cls"), groups).where("cls = comp")
    met = pair_blocks(first, "cluster", "cls", VERIFY).join(shingles, "cls")
    links = links.unionByName(materialize(_compare(met, similarity), "verified"))
    left = materialize(_rest(_named(large.select("cluster", "cls"), connected_components(links))), "left")
    links = links.unionByName(materialize(_compare(left.join(shingles, "cls"), similarity), "verified"))
    return connected_components(links)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` for each document that has an id.

    Documents link if their words (A-Z in lower case) are equal, or if the Jaccard similarity of
    their sets of ``size``-word shingles is at least ``similarity``; component_id is the smallest doc_id
    reachable. Documents without words are alike. Rows that share an id count as one document.
    """
    with scratch(docs.sparkSession):
        drawn = materialize(sketches(docs, size), "sketches")
        classes = drawn.groupBy("d1", "d2").agg(F.min("doc_id").alias("cls"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
        classes = materialize(classes, "classes")
        dealt = pair_blocks(classes.select(F.col("cls").alias("id"), F.explode("bands").alias("shard")), "shard", "id", TREE)
        dealt = dealt.join(classes.select(F.col("cls").alias("id"), "fp"), "id")
        proposed = connected_components(materialize(search_dealt(dealt, WIDE).distinct(), "proposed"))
        # members of clusters, their roots too
        cluster = proposed.unionByName(proposed.select(F.col("component").alias("node"), "component").distinct())
        members = materialize(cluster.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "members")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        groups = _verified(members, texts, size, similarity)
        named = materialize(_named(classes.select("d1", "d2", "cls"), groups).select("d1", "d2", "comp"), "named")
        # rows that share an id may be in several classes: the document takes the smallest
        out = drawn.select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).groupBy("doc_id").agg(F.min("comp").alias("component_id"))
        return materialize(out, "near", keep=True)


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but those of documents that a document of smaller id stands for; rows without an id stay."""
    gone = near_duplicates(docs, size, similarity).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by linked(): null and blank texts have fingerprint zero, extra columns are not read, repeated rows stay."""
    got = linked(fingerprints(read_table(spark, sf_dir, "documents"), 3), 3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
