"""From scores to claims: thresholds, the rule engine, and combinations of two scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx


def above(scored: DataFrame, tau: float | dict[str, float], default: float = 0.5) -> DataFrame:
    """Rows with prob at least tau; tau may go by the column country."""
    if not isinstance(tau, dict):
        return scored.where(F.col("prob") >= tau)
    least = F.lit(default)
    for country, t in tau.items():
        least = F.when(F.col("country") == country, F.lit(t)).otherwise(least)
    return scored.where(F.col("prob") >= least)


#: What rules() reads of records, and which of it are sets.
RULES_READ = ("country", "name_raw", "addr_raw", "name_clean", "tokens", "state", "hn", "city")
RULES_SETS = ("tokens",)


def rules(pairs: DataFrame) -> DataFrame:
    """s1, cid, country and prob of paired() rule_records() rows with s_word; conflicting pairs go.

    A: house number and address agree. B: names nearly equal. C: an address is missing and
    names agree. D: the text score, or its blend with name and address.
    """
    df = pairs.withColumn("_x", F.regexp_replace("a_name_clean", " ", "")).withColumn("_y", F.regexp_replace("b_name_clean", " ", ""))
    df = df.withColumn("_n", sm.string_similarities(F.col("a_name_clean"), F.col("b_name_clean"), ("ratio", "token_sort_ratio")))
    df = df.withColumn("_d", sm.string_similarities(F.col("_x"), F.col("_y"), ("ratio",)))
    df = df.withColumn("_a", sm.string_similarities(F.lower("a_addr_raw"), F.lower("b_addr_raw"), ("token_sort_ratio",)))
    name = F.greatest("_n.ratio", "_n.token_sort_ratio", "_d.ratio")
    addr = F.greatest(sm.jaccard(F.col("a_tokens"), F.col("b_tokens")), F.col("_a.token_sort_ratio"))
    df = df.withColumn("_name", name).withColumn("_addr", addr)
    name, addr, text = F.col("_name"), F.col("_addr"), F.col("s_word")
    missing = (F.trim("a_addr_raw") == "") | (F.trim("b_addr_raw") == "")
    s1, s2 = F.col("a_state"), F.col("b_state")
    state_conflict = (s1 != "") & (s2 != "") & (s1 != s2)
    house = sm.tri_state(F.col("a_hn"), F.col("b_hn"), inside=True)
    c1, c2 = F.col("a_city"), F.col("b_city")
    city = (c1 != "") & (c2 != "") & (c1.contains(c2) | c2.contains(c1))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    drop = ~missing & ((state_conflict & (addr < 0.60)) | ((house == -1) & (addr < 0.50) & (shared == 0)))
    indic = tx.has_indic(F.col("a_name_raw")) | tx.has_indic(F.col("b_name_raw"))
    a = (house == 1) & (addr > 0.75) & (city | (c1 == "") | (c2 == "") | ~state_conflict) & (indic | (name >= 0.25))
    b = (name > 0.90) & (missing | (addr >= 0.25) | (shared > 0) | ~state_conflict)
    c = missing & (name >= 0.88)
    mixed = sm.blend(text=(0.4, text), name=(0.3, name), addr=(0.3, addr))
    d = F.when((text >= 0.35) & (name >= 0.60) & (addr >= 0.35), F.greatest(text, mixed)).otherwise(text)
    prob = F.when(a, F.greatest(F.lit(0.98), text)).when(b | c, F.greatest(F.lit(0.95), text)).otherwise(d)
    return df.where(~drop).select("s1", "cid", F.col("a_country").alias("country"), prob.alias("prob"))


def combine(lexical: DataFrame, semantic: DataFrame, rule: str, targets: DataFrame | None = None) -> DataFrame:
    """Lexical pairs (s1, cid, score) with a second score (s1, cid, sem).

    Rule "a": the greater. "b": the greater, and pairs that only the wider list has.
    "c": 0.6 lexical + 0.4 semantic (zero where it is missing). Queries outside ``targets``
    (s1) keep their lexical scores.
    """
    how = "full" if rule == "b" else "left"
    both = lexical.select("s1", "cid", "score").join(semantic.select("s1", "cid", "sem"), ["s1", "cid"], how)
    lex, sem = F.col("score"), F.col("sem")
    new: Column = 0.6 * lex + 0.4 * F.coalesce(sem, F.lit(0.0)) if rule == "c" else F.greatest(lex, sem)
    if targets is None:
        return both.select("s1", "cid", new.alias("score"))
    aim = targets.select("s1", F.lit(True).alias("_aim")).distinct()
    both = both.join(aim, "s1", "left").where("_aim OR score IS NOT NULL")
    return both.select("s1", "cid", F.when(F.col("_aim"), new).otherwise(lex).alias("score"))
