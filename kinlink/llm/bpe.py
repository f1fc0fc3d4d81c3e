"""Byte-level BPE encoding and decoding through a sentencepiece model made from a vocabulary.

The model is serialised by hand from the ranks: each byte string becomes a piece of
printable characters (one per byte), its score is the negative rank, and normalisation is
the identity, so sentencepiece's "merge the best-scored pair, leftmost first" is the merge
order of the ranks. Nothing is trained. Texts are cut into pre-tokens by the tokenizer's
pattern and each pre-token is encoded by itself; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, slices

#: Most pre-tokens a worker remembers; beyond it the memory is cleared and filled anew.
CACHE = 100_000
#: Pre-tokens longer than this are encoded without being remembered.
CACHE_CHARS = 64
#: A vocabulary of more bytes than this is refused as a broadcast.
MAX_MODEL_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the id after the last is <unk>."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each byte must be a piece")
    chars = byte_chars()
    out = bytearray()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in piece).encode()
        body = _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)
        out += _field(1, body)
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(ranks) + 1))  # model_type BPE, vocab_size
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBPE:
    """Encoder of one vocabulary."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.map = dict(enumerate(byte_chars()))
        self.known: dict[str, bytes] = {}

    def _encode_new(self, tokens: list[str]) -> dict[str, bytes]:
        # latin-1 gives one character a byte; translate then maps bytes to their stand-ins
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for t in tokens]
        ids = self.sp.encode(mapped, out_type=int, num_threads=1)
        return {t: np.asarray(i, "<u4").tobytes() for t, i in zip(tokens, ids, strict=True)}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        known = self.known
        fresh = [t for t in set(tokens) if t not in known]
        if fresh:
            got = self._encode_new(fresh)
            if len(known) + len(got) > CACHE:
                known.clear()
                fresh = [t for t in set(tokens) if t not in got]
                got.update(self._encode_new(fresh))
            known.update((t, i) for t, i in got.items() if len(t) <= CACHE_CHARS)
            if any(len(t) > CACHE_CHARS for t in got) or len(got) > CACHE:
                return b"".join([got[t] if t in got else known[t] for t in tokens])
        return b"".join(map(known.__getitem__, tokens))


class ByteDecoder:
    """The inverse mapping: each id's piece, and each of its characters' byte."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_chars())}
        self.pieces = [bytes(back[c] for c in sp.id_to_piece(i)) for i in range(sp.vocab_size() - 1)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _encoder(model: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(model, pattern)


@lru_cache(1)
def _decoder(model: bytes) -> ByteDecoder:
    return ByteDecoder(model)


def _shared_model(spark: SparkSession, ranks: dict[bytes, int]):
    model = serialise_model(ranks)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the vocabulary's model has {len(model)} bytes; the bound is {MAX_MODEL_BYTES}")
    return spark.sparkContext.broadcast(model)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``ids``: binary, four bytes an id, little-endian.

    Null and empty texts give no ids. Special tokens' strings are ordinary text. A column
    that is already named ``ids`` is replaced. Rows are kept as they are, repeats included.
    """
    model = _shared_model(docs.sparkSession, ranks)
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(model.value, pattern)
        for b in slices(batches):
            got = [tool.encode(t) if t else b"" for t in b.column(text).to_pylist()]
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.binary())], [*keep, ids])

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids give no bytes."""
    model = _shared_model(encoded.sparkSession, ranks)
    keep = [c for c in encoded.columns if c != out]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _decoder(model.value)
        for b in slices(batches):
            got = [tool.decode(i) if i else b"" for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.binary())], [*keep, out])

    return encoded.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents, through encode() and decode()."""
    both = decode(encode(docs.select("doc_id", "text"), ranks, pattern), ranks)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by digests(): null and empty texts have no tokens, repeated rows stay, extra columns are not read."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
