"""A cleaning pipeline over documents: each stage takes what the one before it kept.

Language identification drops what is in no learnt language, line dedup cuts repeated lines,
near-dedup keeps one document of each group, decontamination drops documents that hold
benchmark items, and byte-level BPE turns what is left into tokens (and checks them by
decoding). All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe, decontam, langid, lines, simhash
from kinlink.llm.common import discard, materialize, read_table, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learnt; null texts and texts without a letter go, repeated rows and null ids stay."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; n_chars follows, null texts become empty, rows without an id stay as they are."""
    return lines.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 of five-word shingles; null and blank texts are one group, rows without an id stay."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null texts hold none, repeated rows and null ids stay or go by their text."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source (null where they were), n_tokens (0 for null texts), the ids (four bytes each, little-endian), and digests of ids and decoded bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(coded, ranks)
    coded = both.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )
    return coded


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The kernel classifier and the tokenizer have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage wrote on its way goes with it
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
