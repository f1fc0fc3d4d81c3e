"""Term weights as long tables, and products of sparse matrices as joins.

A matrix is rows ``(country, doc, term, w)``. Vocabularies are fitted for each country on a
part of the documents (the first rows by ordinal, as ``sample`` says) and hold document
frequencies; terms outside them vanish before rows are scaled to length one. Frequency
caps bound the work of the join: a term joins at most (max_df x n) squared pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Vectorizer:
    min_df: int = 2
    max_df: float = 0.03
    max_features: int = 150_000
    #: Below this many sampled documents max_df is raised to 10 / n.
    small: int = 500
    binary: bool = False


def word_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def char_terms(text: Column, low: int, high: int) -> Column:
    """N-grams within words that have a blank on either side; a word shorter than n gives itself once."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    none = F.array().cast("array<string>")

    def slide(w: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
        return F.when(F.length(w) >= n, every).otherwise(none)

    def grams(w: Column) -> Column:
        whole = F.when(F.length(w) < low, F.array(w)).otherwise(none)
        return F.concat(whole, *(slide(w, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(words, grams))


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """``(country, doc, side, term, tf)``"""
    return docs.select("country", "doc", "side", F.explode(terms).alias("term")).groupBy("country", "doc", "side", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, docs: DataFrame, v: Vectorizer, sample: Column | None = None) -> DataFrame:
    """``(country, term, df, n, place)`` of the sampled documents; ties at max_features go to the lesser term."""
    if sample is not None:
        docs = docs.where(sample)
        counts = counts.join(docs.select("doc"), "doc", "left_semi")
    sizes = docs.groupBy("country").agg(F.count(F.lit(1)).alias("n"))  # a row for each country
    share = F.when(F.col("n") < v.small, F.greatest(F.lit(v.max_df), F.lit(10.0) / F.col("n"))).otherwise(F.lit(v.max_df))
    # a row of counts may stand for m equal documents
    m = F.col("m") if "m" in counts.columns else F.lit(1)
    own = counts.groupBy("country", "term").agg(F.sum(m).alias("df"), F.sum(F.col("tf") * m).alias("cf")).join(F.broadcast(sizes), "country")
    own = own.where((F.col("df") >= v.min_df) & (F.col("df") <= F.least(share, F.lit(1.0)) * F.col("n")))
    order = Window.partitionBy("country").orderBy(F.desc("cf"), "term")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= v.max_features).select("country", "term", "df", "n", "place")


def raw_weight(v: Vectorizer) -> Column:
    """The weight of a term of tf, df and n before rows are scaled."""
    return F.lit(1.0) if v.binary else (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def weights(counts: DataFrame, vocab: DataFrame, v: Vectorizer) -> DataFrame:
    """``(country, doc, side, term, w)``: 1 if binary, else (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows of length one."""
    own = counts.join(vocab, ["country", "term"])
    if v.binary:
        return own.select("country", "doc", "side", "term", F.lit(1.0).alias("w"))
    own = own.withColumn("w", raw_weight(v))
    norm = own.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return own.join(norm, "doc").select("country", "doc", "side", "term", (F.col("w") / F.col("norm")).alias("w"))


def product(rows: DataFrame) -> DataFrame:
    """``(country, s1, cid, score)``: the inner products of side S1 with the others that share a term."""
    left = rows.where("side = 'S1'").select("country", F.col("doc").alias("s1"), "term", F.col("w").alias("a"))
    right = rows.where("side <> 'S1'").select("country", F.col("doc").alias("cid"), "term", F.col("w").alias("b"))
    return left.join(right, ["country", "term"]).groupBy("country", "s1", "cid").agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def set_jaccard(rows: DataFrame) -> DataFrame:
    """``(country, s1, cid, score)`` of binary rows: common terms over all terms, both within the vocabulary."""
    common = product(rows)
    size = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    a, b = size.select(F.col("doc").alias("s1"), F.col("n").alias("_a")), size.select(F.col("doc").alias("cid"), F.col("n").alias("_b"))
    both = common.join(a, "s1").join(b, "cid")
    return both.select("country", "s1", "cid", (F.col("score") / (F.col("_a") + F.col("_b") - F.col("score"))).alias("score"))


def top_k(pairs: DataFrame, k: int, by: str = "s1") -> DataFrame:
    """The k best of each query; scores count to nine digits, ties go to the lesser candidate."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "cid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
