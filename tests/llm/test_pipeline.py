import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from helpers import empty, table
from test_decontam import plain as plain_leaks
from test_lines import LOW, SPACE
from test_simhash import plain_near

from kinlink.llm import bpe, registry


def plain_pipeline(docs, items):
    """All stages over a list of (doc_id, text), without Spark."""
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    owner = {}
    for d, t in docs:
        for x in t.split("\n"):
            k = x.strip(SPACE).translate(LOW)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, d), d)
    docs = [(d, "\n".join(x for x in t.split("\n") if owner.get(x.strip(SPACE).translate(LOW), d) == d)) for d, t in docs]
    first = plain_near(docs)
    docs = [(d, t) for d, t in docs if first[d] == d]
    leaked = {d for d, _ in plain_leaks(docs, items)}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for d, t in docs:
        if d not in leaked:
            ids = coder.encode_ordinary(t)
            out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_run_as_plain_code_does(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == plain_pipeline(docs, items)
    assert len(got) < len(docs)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString(), name


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages_on_empty_tables_and_odd_rows(spark, sf):
    for rows in (empty(spark), table(spark)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() <= rows.count()
    assert docs.where("doc_id IS NULL").count() == 1 and docs.where("ids IS NULL").count() == 0
