import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import documents, empty, table

from kinlink.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["<|endoftext|> </s> <unk>", "▁x\0y", "a" * 5000, " " * 3000 + "\n", "🙂‍🙂́e 日本", "▁", "it's 12345 they'll"]


def test_every_piece_encodes_to_its_rank():
    own = bpe.ByteBPE(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
    chars = bpe.byte_chars()
    for piece, rank in RANKS.items():
        assert own.sp.encode("".join(chars[b] for b in piece)) == [rank]


def test_encode_and_decode_as_the_library_does(spark):
    rows = documents() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    coded = bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS).collect()
    want = sorted((t or "", ORACLE.encode_ordinary(t or "")) for _, t, *_ in rows)
    got = sorted((bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()) for r in back)
    assert got == want


def test_clashing_columns_and_empty_tables(spark):
    docs = table(spark).selectExpr("*", "'x' AS ids", "1 AS decoded")
    assert bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == docs.count()
    assert bpe.digests(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_full_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.ByteBPE(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
    for t in ["one two three four five", "six seven", "one two" + "x" * 100]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ORACLE.encode_ordinary(t)


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
