"""Windows of a fixed number of tokens that also start in a document of smaller doc_id.

The frame of the two substring operators; a solver does the string work in shards.

1. Anchors. The anchor of a window is the least hash of its k-grams, so equal windows have
   equal anchors. Documents are dealt to packs; a pack sends the distinct anchors of its
   documents to buckets (five bytes each, packed), and buckets answer with the anchors that
   two documents share. An anchor costs one entry a pack, however frequent it is.
2. Segments. Consecutive windows of one shared anchor, with the tokens they cover, go to the
   anchor's shard, equal ones of a pack once, with the pack's smallest document that holds them.
   A pack sends one row for each tray of shards, which are then solved one by one.
   Windows of an anchor that very many packs hold go one by one to the shard of their content,
   so no shard grows with one passage. Where a segment stands in documents never leaves its pack.
3. A solver finds, within a shard, each segment's first document, and what that repeats of smaller
   ids; other documents with that segment repeat all of it. Both return to the packs, which
   find their segments anew (they follow from the texts and the shared anchors) and cut.

Texts equal to one of a smaller doc_id are known by a digest and stay out of it: they repeat
whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most windows of a segment, and tokens hashed at a time.
RUN = 63
SLICE = 1 << 18
#: An anchor that more packs than this hold is dealt by window content.
HOT_PACKS = 256
#: Bits of an anchor within its bucket; anchors that agree in them only share a segment's shard, contents decide.
KEY_BITS = 39

U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k tokens in a row, from those of halves."""
    powers, size, done, out = x, 1, 0, None
    while True:
        if k & size:
            part = powers[done:]
            out = part if out is None else out[: len(part)] * U(0xD6E8FEB86659FD93) + part
            done += size
        if size * 2 > k:
            break
        powers = _mix(powers[:-size] * U(0xA0761D6478BD642F) + powers[size:])
        size *= 2
    return _mix(out[: len(x) - k + 1])


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchor_slices(x: np.ndarray, window: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first, anchors)`` of the windows that start at first, first + 1, ..."""
    for at in range(0, len(x) - window + 1, SLICE):
        yield at, window_minima(gram_hashes(x[at : at + SLICE + window - 1], k), window - k + 1)


class Tokens:
    """A text as tokens: hashes, and the bytes of a range of them."""

    def __init__(self, text: str) -> None:
        raise NotImplementedError


_BYTE_HASHES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)


class ByteTokens(Tokens):
    def __init__(self, text: str) -> None:
        self.data = text.encode("utf-8", "surrogatepass")
        self.n = len(self.data)

    def hashes(self) -> np.ndarray:
        return _BYTE_HASHES[np.frombuffer(self.data, np.uint8)]

    def piece(self, a: int, b: int) -> bytes:
        return self.data[a:b]

    def keep(self, mask: np.ndarray) -> bytes:
        return np.frombuffer(self.data, np.uint8)[mask].tobytes()


class WordTokens(Tokens):
    def __init__(self, text: str) -> None:
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, self.n)

    def piece(self, a: int, b: int) -> bytes:
        return b" ".join(self.words[a:b])

    def keep(self, mask: np.ndarray) -> bytes:
        return b" ".join([w for w, k in zip(self.words, mask.tolist(), strict=True) if k])


def _pack40(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _squeeze(b: bytes) -> bytes:
    """Compressed bytes, after their length."""
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(b, asbytes=True)


def _expand(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _split(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys of a sorted array."""
    if len(keys):
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(keys[a]), slice(a, b)


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


MAIL = "pack int, kind int, about long, payload binary"
MAIL_NAMES, MAIL_KINDS = ["pack", "kind", "about", "payload"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
OWNER, SHARED, FOUND = 0, 1, 2
SEGMENT_NAMES = ["tray", "pack", "shards", "keys", "sizes", "content", "docs"]
SEGMENTS = "tray long, pack int, shards binary, keys binary, sizes binary, content binary, docs binary"
#: Bytes of text for each shard; what a shard holds of it are its shared segments.
SHARD_BYTES = 2 << 20
#: Most bytes of text for each bucket and each tray of shards where texts are many.
TRAY_BYTES = 16 << 20

#: (contents, owners, window) -> for each content the token ranges that a smaller owner's content holds
Solver = Callable[[list[bytes], list[int], int], list[list[tuple[int, int]]]]


def sizes_for(total: int, partitions: int) -> tuple[int, int, int]:
    """Packs, buckets of anchors, and shards, for so many bytes of text.

    A pack has one row for each bucket, so rows grow with packs times buckets: packs grow first, to 8 MB, and buckets
    beyond some hundreds only with TRAY_BYTES; the size of a pack limits them. Shards follow the bytes of all texts.
    There are buckets and shards for all partitions of a shuffle, as far as that.
    """
    pack = min(32 << 20, max(4 << 20, min(8 << 20, int(64 * total**0.5)), int(6.4 * total**0.5)))
    buckets = max(min(total >> 20, 512), min(2 * partitions, 1024), total // TRAY_BYTES)
    return max(8, total // pack), min(buckets, pack // 256), max(total // SHARD_BYTES, 2 * partitions)


def trays_for(total: int, partitions: int) -> int:
    """Trays of shards: a pack has a row for each, as for buckets; each holds one shard where texts are few."""
    return max(min(total // SHARD_BYTES, 512), min(2 * partitions, 512), total // TRAY_BYTES)


def _pack_of(packs: int) -> Column:
    # documents without an id are dealt by text
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(packs)).cast("int")


def remove_repeats(
    docs: DataFrame, tokens: type[Tokens], window: int, k: int, solver: Solver, hot_packs: int = HOT_PACKS
) -> DataFrame:
    """``(doc_id, n_tokens, n_removed, n_spans, kept)`` of each row of ``(doc_id, text)``.

    A token goes if a window of ``window`` tokens that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. kept is what is left, as bytes;
    n_spans counts maximal removed runs. Null texts are empty. Rows without a doc_id stay
    whole and remove nothing; rows that share a doc_id do not remove each other's windows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs, buckets, shards = sizes_for(total, partitions)
    trays = trays_for(total, partitions)
    dealt = docs.withColumn("pack", _pack_of(packs)).repartition("pack")

    firsts = docs.where("doc_id is not null").groupBy(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    owners = firsts.agg(F.min("doc_id").alias("doc_id")).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(packs)).cast("int").alias("pack"),
        F.lit(OWNER).alias("kind"),
        F.col("doc_id").alias("about"),
        F.lit(None).cast("binary").alias("payload"),
    ).distinct()

    def canonical(h: np.ndarray) -> np.ndarray:
        return ((h // U(buckets)) & U((1 << KEY_BITS) - 1)) * U(buckets) + h % U(buckets)

    def own_texts(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, Tokens]]:
        first = {a for a, kind in zip(right["about"].to_pylist(), right["kind"].to_pylist(), strict=True) if kind == OWNER}
        for i, text in zip(left["doc_id"].to_pylist(), left["text"], strict=True):
            if i in first and len(text := text.as_py()) >= window // 4:
                t = tokens(text)
                if t.n >= window:
                    yield i, t

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct anchors of a pack, by bucket; the lowest bit says that two documents hold it."""
        seen = [
            np.unique(np.concatenate([np.unique(m) for _, m in anchor_slices(t.hashes(), window, k)]))
            for _, t in own_texts(left, right)
        ]
        rows = []
        if seen:
            h, count = np.unique(np.concatenate(seen), return_counts=True)
            bucket = h % U(buckets)
            order = np.argsort(bucket, kind="stable")
            entry = ((h // U(buckets)) & U((1 << KEY_BITS) - 1)) << U(1) | (count > 1).astype(np.uint64)
            pack = left["pack"][0].as_py()
            rows = [(b, pack, _pack40(entry[order[own]])) for b, own in _split(bucket[order])]
        return _table(rows, ["bucket", "pack", "payload"], [pa.int32(), pa.int32(), pa.binary()])

    def answer(asked: pa.Table) -> pa.Table:
        """For each pack the anchors of the bucket that are shared; the lowest bit says that they are hot."""
        if not asked.num_rows:
            return _table([], MAIL_NAMES, MAIL_KINDS)
        parts = [_unpack40(p) for p in asked["payload"].to_pylist()]
        entry = np.concatenate(parts)
        pack = np.repeat(asked["pack"].to_numpy(), [len(p) for p in parts])
        order = np.argsort(entry, kind="stable")
        entry, pack = entry[order], pack[order]
        _, where, count = np.unique(entry >> U(1), return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        several[where[(entry & U(1)) == 1]] = True
        keep = ((count > 1) | several)[where]
        out = ((entry >> U(1)) << U(1) | (count > hot_packs)[where].astype(np.uint64))[keep]
        pack = pack[keep]
        order = np.argsort(pack, kind="stable")
        bucket = asked["bucket"][0].as_py()
        rows = [(p, SHARED, bucket, _pack40(out[order[own]])) for p, own in _split(pack[order])]
        return _table(rows, MAIL_NAMES, MAIL_KINDS)

    def pieces(left: pa.Table, right: pa.Table) -> dict[int, dict[tuple[int, int, bytes], list[tuple[int, int]]]]:
        """The segments of shared anchors of a pack, by tray: (shard, anchor, content) and where it stands (document, token)."""
        found = [
            (_unpack40(p), b)
            for kind, b, p in zip(right["kind"].to_pylist(), right["about"].to_pylist(), right["payload"].to_pylist(), strict=True)
            if kind == SHARED
        ]
        by_tray: dict[int, dict[tuple[int, int, bytes], list[tuple[int, int]]]] = {}
        if not found:
            return by_tray
        shared = np.concatenate([(e >> U(1)) * U(buckets) + U(b) for e, b in found])
        hot = np.concatenate([(e & U(1)) == 1 for e, _ in found])
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        for doc, t in own_texts(left, right):
            for first, m in anchor_slices(t.hashes(), window, k):
                new = np.concatenate(([True], m[1:] != m[:-1]))
                starts = np.flatnonzero(new)
                key = canonical(m[starts])
                at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                pick = np.flatnonzero(shared[at] == key)
                ends = np.append(starts[1:], len(m))
                for c, is_hot, a, b in zip(key[pick].tolist(), hot[at[pick]].tolist(), (starts[pick] + first).tolist(), (ends[pick] + first).tolist(), strict=True):
                    step = 1 if is_hot else RUN
                    for s in range(a, b, step):
                        piece = t.piece(s, min(s + step, b) - 1 + window)
                        shard = (crc32(piece, c & 0xFFFFFFFF) if is_hot else c * 0x9E3779B1 >> 7) % shards
                        by_tray.setdefault(shard % trays, {}).setdefault((shard, c, piece), []).append((doc, s))
        return by_tray

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each tray the pack's segments, sorted, and the smallest document of each."""
        rows = []
        by_tray = pieces(left, right)
        pack = left["pack"][0].as_py() if by_tray else None
        for tray, own in by_tray.items():
            names = sorted(own)
            rows.append((
                tray, pack, np.concatenate(np.unique([s for s, _, _ in names], return_counts=True)).astype("<i8").tobytes(), np.array([c for _, c, _ in names], "<u8").tobytes(),
                _squeeze(np.array([len(p) for _, _, p in names], "<u4").tobytes()), _squeeze(b"".join([p for _, _, p in names])),
                _squeeze(np.array([min(own[x])[0] for x in names], "<i8").tobytes()),
            ))
        return _table(rows, SEGMENT_NAMES, [pa.int64(), pa.int32(), *[pa.binary()] * 5])

    def solve(dealt: pa.Table) -> pa.Table:
        """For each pack the first documents of its segments in a tray, and spans within those documents' own."""
        if not dealt.num_rows:
            return _table([], MAIL_NAMES, MAIL_KINDS)
        sent, at = [], {}  # what each pack sent, and by shard the packs and the places of its segments there
        for n, row in enumerate(dealt.to_pylist()):
            ends = np.cumsum(np.frombuffer(_expand(row["sizes"]), "<u4"), dtype=np.int64)
            sent.append((np.frombuffer(row["keys"], "<u8"), np.concatenate(([0], ends)), _expand(row["content"]), np.frombuffer(_expand(row["docs"]), "<i8")))
            shard, count = np.frombuffer(row["shards"], "<i8").reshape(2, -1)
            for s, a, b in zip(shard.tolist(), (np.cumsum(count) - count).tolist(), np.cumsum(count).tolist(), strict=True):
                at.setdefault(s, []).append((n, a, b))
        first = [np.empty(len(docs_), np.int64) for *_, docs_ in sent]
        spans: list[list[tuple[int, int, int]]] = [[] for _ in sent]
        for places in at.values():
            index: dict[tuple[int, bytes], int] = {}
            which = []
            for n, a, b in places:
                keys, edges, content, _ = sent[n]
                edge = edges[a : b + 1].tolist()
                which.append(np.array([index.setdefault((c, content[x:y]), len(index)) for c, x, y in zip(keys[a:b].tolist(), edge[:-1], edge[1:], strict=True)]))
            owner = np.full(len(index), np.iinfo(np.int64).max)
            for w, (n, a, b) in zip(which, places, strict=True):
                np.minimum.at(owner, w, sent[n][3][a:b])
            own = solver([p for _, p in index], owner.tolist(), window)
            for w, (n, a, b) in zip(which, places, strict=True):
                first[n][a:b] = owner[w]
                spans[n] += [(a + i, x, y) for i in np.flatnonzero(sent[n][3][a:b] == owner[w]).tolist() for x, y in own[w[i]]]
        rows = []
        for pack, f, s in zip(dealt["pack"].to_pylist(), first, spans, strict=True):
            payload = _squeeze(np.concatenate(([len(f)], f, np.array(s, np.int64).ravel())).astype("<i8").tobytes())
            rows.append((pack, FOUND, dealt["tray"][0].as_py(), payload))
        return _table(rows, MAIL_NAMES, MAIL_KINDS)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        first, got = set(), {}
        for kind, about, payload in zip(right["kind"].to_pylist(), right["about"].to_pylist(), right["payload"].to_pylist(), strict=True):
            if kind == OWNER:
                first.add(about)
            elif kind == FOUND:
                got[about] = np.frombuffer(_expand(payload), "<i8")
        spans: dict[int, list[tuple[int, int]]] = {}
        for tray, own in pieces(left, right).items() if got else ():
            answer_ = got[tray]
            n = int(answer_[0])
            within: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in answer_[1 + n :].reshape(-1, 3).tolist():
                within.setdefault(i, []).append((a, b))
            for i, (name, owner) in enumerate(zip(sorted(own), answer_[1 : 1 + n].tolist(), strict=True)):
                whole = [(0, name[2].count(b" ") + 1 if tokens is WordTokens else len(name[2]))]
                for doc, at in own[name]:
                    for a, b in whole if doc > owner else within.get(i, ()):
                        spans.setdefault(doc, []).append((at + a, at + b))
        rows = []
        for i, text in zip(left["doc_id"].to_pylist(), left["text"], strict=True):
            t = tokens(text.as_py())
            gone = np.zeros(t.n, bool)
            if i is not None and i not in first:
                gone[:] = t.n >= window
            elif i in spans:
                depth = np.zeros(t.n + 1, np.int64)
                own = np.minimum(np.array(spans[i]), t.n)
                np.add.at(depth, own[:, 0], 1)
                np.add.at(depth, own[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
            removed = int(gone.sum())
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if removed else 0
            rows.append((i, t.n, removed, runs, t.keep(~gone) if removed else t.piece(0, t.n)))
        return _table(rows, ["doc_id", "n_tokens", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    by_pack = dealt.groupBy("pack")
    asked = by_pack.cogroup(owners.groupBy("pack")).applyInArrow(ask, "bucket int, pack int, payload binary")
    # read twice: by those that send segments, and by those that cut
    shared = materialize(owners.unionByName(asked.groupBy("bucket").applyInArrow(answer, MAIL)), "shared")
    found = by_pack.cogroup(shared.groupBy("pack")).applyInArrow(segments, SEGMENTS)
    solved = found.groupBy("tray").applyInArrow(solve, MAIL)
    out = by_pack.cogroup(shared.unionByName(solved).groupBy("pack"))
    return out.applyInArrow(cut, "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary")
