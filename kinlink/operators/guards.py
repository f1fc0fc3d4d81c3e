"""Precision guards over matched pairs.

``facts`` are hardening() records; matches are ``(s1, cid, ord)``, ord being a candidate's
place in its query's list. A candidate without facts is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import address as ad
from ..functions import similarity as sm


def with_facts(matches: DataFrame, facts: DataFrame) -> DataFrame:
    keep = ("name", "addr", "hn", "pc", "state", "tokens")
    a = facts.where("src = 'S1'").select(F.col("entity_id").alias("s1"), *(F.col(c).alias(f"a_{c}") for c in keep))
    b = facts.where("src <> 'S1'").select(F.col("entity_id").alias("cid"), *(F.col(c).alias(f"b_{c}") for c in keep), F.lit(True).alias("known"))
    return matches.join(a, "s1", "left").join(b, "cid", "left").na.fill(False, ["known"])


def name_frequency(facts: DataFrame, matches: DataFrame) -> DataFrame:
    """``(name, freq)`` over all queries and the candidates that are matched."""
    used = matches.select(F.col("cid").alias("entity_id")).distinct()
    rows = facts.where("src = 'S1'").select("name").unionByName(facts.where("src <> 'S1'").join(used, "entity_id", "left_semi").select("name"))
    return rows.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("freq"))


def premise_conflict() -> Column:
    """House numbers differ, and neither stands in the other's address."""
    a, b = F.col("a_hn"), F.col("b_hn")
    return (a != "") & (b != "") & (a != b) & ~(F.col("b_addr").contains(a) | F.col("a_addr").contains(b))


def postal_conflict() -> Column:
    a, b = F.col("a_pc"), F.col("b_pc")
    return (a != "") & (b != "") & (a != b)


def chain_conflict(least: int = 20) -> Column:
    """A frequent name with both addresses and nothing that ties the places together."""
    both, union = F.size(F.array_intersect("a_tokens", "b_tokens")), F.size(F.array_union("a_tokens", "b_tokens"))
    likeness = both / F.greatest(union, F.lit(1))
    same_state = (F.col("a_state") != "") & (F.col("a_state") == F.col("b_state"))
    tied = ((F.col("a_pc") != "") & (F.col("a_pc") == F.col("b_pc"))) | F.when(same_state, likeness >= 0.15).otherwise(likeness >= 0.25)
    return (F.col("freq") >= least) & (F.col("a_addr") != "") & (F.col("b_addr") != "") & ~tied


def guarded(matches: DataFrame, facts: DataFrame, chain: int = 20) -> DataFrame:
    """Matches with the ``reason`` of the first guard that fails, or null."""
    rows = with_facts(matches, facts)
    freq = name_frequency(facts, matches)
    rows = rows.join(freq.select(F.col("name").alias("a_name"), "freq"), "a_name", "left").na.fill(0, ["freq"])
    checked = F.when(F.col("known") & F.col("a_name").isNotNull(), F.when(premise_conflict(), F.lit("premise")).when(postal_conflict(), F.lit("postal")).when(chain_conflict(chain), F.lit("chain")))
    return rows.withColumn("reason", checked)


def marginal_singletons(rows: DataFrame, facts: bool = True, address: float = 0.25, name: float = 0.92, bare: float = 0.85, on_kept: bool = False) -> DataFrame:
    """Sets the reason "singleton" on a query's one match (all along, or ``on_kept``: after the other guards) that is unlike it."""
    own = Window.partitionBy("s1")
    rows = rows.withColumn("_all", F.count(F.lit(1)).over(own)).withColumn("_kept", F.sum(F.col("reason").isNull().cast("int")).over(own))
    single = (F.col("_kept") == 1) if on_kept else (F.col("_all") == 1) & (F.col("_kept") == 1)
    rows = rows.withColumn("_n", sm.string_similarities(F.coalesce("a_name", F.lit("")), F.coalesce("b_name", F.lit("")), ("token_sort_ratio",)))
    rows = rows.withColumn("_a", sm.string_similarities(F.coalesce("a_addr", F.lit("")), F.coalesce("b_addr", F.lit("")), ("token_sort_ratio",)))
    n, a = F.round("_n.token_sort_ratio", 9), F.round("_a.token_sort_ratio", 9)
    unlike = F.when((F.col("a_addr") != "") & (F.col("b_addr") != ""), (a < address) & (n < name)).otherwise(n < bare)
    reason = F.when(F.col("reason").isNull() & single & F.col("known") & unlike, F.lit("singleton")).otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).drop("_all", "_kept", "_n", "_a")


def degree_cap(rows: DataFrame, s2: int = 5, s3: int = 6) -> DataFrame:
    """Sets the reason "degree" on kept matches beyond the first s2 of S2 and s3 of S3, in list order."""
    third = F.col("cid").startswith("S3-")
    own = Window.partitionBy("s1", third, F.col("reason").isNull()).orderBy("ord", "cid")
    place = F.row_number().over(own)
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (place > F.when(third, F.lit(s3)).otherwise(F.lit(s2))), F.lit("degree")).otherwise(F.col("reason")))


def harden(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """All guards in order: premise, postal, chain, singleton, degree."""
    return degree_cap(marginal_singletons(guarded(matches, facts)))


def telemetry(rows: DataFrame) -> DataFrame:
    """``(reason, n)``; what stays is "kept"."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def weak_queries(claims: DataFrame, scored: DataFrame, tau: float) -> DataFrame:
    """Claims without those of queries whose best score of all is below tau."""
    best = scored.groupBy("s1").agg(F.max("prob").alias("_best")).where(F.col("_best") >= tau)
    return claims.join(best.select("s1"), "s1", "left_semi")


def chain_names(records: DataFrame, least: int = 50) -> DataFrame:
    """Clean corpus names of more than ``least`` records."""
    return records.where("side <> 'S1' AND name_clean <> ''").groupBy("name_clean").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > least)


def chain_zero(scored: DataFrame, names: DataFrame, likeness: float = 0.25) -> DataFrame:
    """prob 0 for candidates with a chain's name and an unlike address; ``scored`` has b_name_clean and addr_token_set."""
    rows = scored.join(names.select(F.col("name_clean").alias("b_name_clean"), F.lit(True).alias("_chain")), "b_name_clean", "left")
    hit = F.coalesce("_chain", F.lit(False)) & (F.col("addr_token_set") < likeness)
    return rows.withColumn("prob", F.when(hit, F.lit(0.0)).otherwise(F.col("prob"))).drop("_chain")


def simple_cleanup(matches: DataFrame, records: DataFrame, most: int = 8) -> DataFrame:
    """Drops pairs whose leading number or last code conflicts; a query with more than ``most`` loses all."""
    own = records.select("entity_id", ad.house_number_digits(F.col("address")).alias("h"), ad.postal_code_last(F.col("address")).alias("p"))
    a = own.select(F.col("entity_id").alias("s1"), F.col("h").alias("h1"), F.col("p").alias("p1"))
    b = own.select(F.col("entity_id").alias("cid"), F.col("h").alias("h2"), F.col("p").alias("p2"))
    rows = matches.join(a, "s1", "left").join(b, "cid", "left")
    house = (F.col("h1") != "") & (F.col("h2") != "") & (F.col("h1") != F.col("h2"))
    code = (F.col("p1") != "") & (F.col("p2") != "") & (F.col("p1") != F.col("p2"))
    size = Window.partitionBy("s1")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(size)).where(F.col("_n") <= most)
    return rows.where(~(F.coalesce(house, F.lit(False)) | F.coalesce(code, F.lit(False)))).select("s1", "cid", "ord")
