"""Quality of links against the truth. Edges are ``(s1, cid)``; ``ids`` lists the queries judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .assign import uncapped


def per_query(ids: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """``(s1, t, p, tp, precision, recall, f05)`` of each query; both sides empty counts 1, one empty or no hit 0."""
    t = truth.select("s1", "cid").distinct().withColumn("t", F.lit(1))
    p = links.select("s1", "cid").distinct().withColumn("p", F.lit(1))
    sums = t.join(p, ["s1", "cid"], "full").groupBy("s1").agg(
        F.sum(F.coalesce("t", F.lit(0))).alias("t"), F.sum(F.coalesce("p", F.lit(0))).alias("p"), F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp")
    )
    rows = ids.select("s1").distinct().join(sums, "s1", "left").na.fill(0, ["t", "p", "tp"])
    rows = rows.withColumn("precision", share(F.col("tp"), F.col("p"), F.col("t"))).withColumn("recall", share(F.col("tp"), F.col("t"), F.col("p")))
    return rows.withColumn("f05", f05(F.col("tp"), F.col("p"), F.col("t")))


def share(hit: Column, of: Column, other: Column) -> Column:
    return F.when((of == 0) & (other == 0), F.lit(1.0)).when(of == 0, F.lit(0.0)).otherwise(hit / of)


def f05(tp: Column, p: Column, t: Column) -> Column:
    precision, recall = tp / p, tp / t
    return F.when((p == 0) & (t == 0), F.lit(1.0)).when((p == 0) | (t == 0) | (tp == 0), F.lit(0.0)).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def macro(ids: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """One row: n, macro precision, recall and F0.5, and how many queries are perfect, zero or in between."""
    rows = per_query(ids, truth, links)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f05").alias("f05"),
        F.sum((F.col("f05") == 1).cast("long")).alias("perfect"),
        F.sum((F.col("f05") == 0).cast("long")).alias("zero"),
        F.sum(((F.col("f05") > 0) & (F.col("f05") < 1)).cast("long")).alias("part"),
        F.percentile("f05", F.lit(0.5)).alias("median"),
    )


def micro(truth: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pair counts, and precision, recall and F0.5 over pairs."""
    t = truth.select("s1", "cid").distinct().withColumn("t", F.lit(1))
    p = links.select("s1", "cid").distinct().withColumn("p", F.lit(1))
    sums = t.join(p, ["s1", "cid"], "full").agg(F.count("t").alias("t"), F.count("p").alias("p"), F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"))
    tp, n, m = F.col("tp"), F.col("p"), F.col("t")
    return sums.select("t", "p", "tp", share(tp, n, m).alias("precision"), share(tp, m, n).alias("recall"), f05(tp, n, m).alias("f05"))


def blocking_recall(truth: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, their share, and the part of all pairs that is spared."""
    found = truth.select("s1", "cid").distinct().join(candidates.select("s1", "cid").distinct().withColumn("hit", F.lit(1)), ["s1", "cid"], "left")
    row = found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found"))
    sides = records.groupBy("country").agg(F.sum((F.col("src") == "S1").cast("long")).alias("a"), F.sum((F.col("src") != "S1").cast("long")).alias("b"))
    every = sides.agg(F.sum(F.col("a") * F.col("b")).alias("every"))
    made = candidates.select("s1", "cid").distinct().agg(F.count(F.lit(1)).alias("made"))
    # three rows of one line each
    one = row.withColumn("_k", F.lit(1)).join(every.withColumn("_k", F.lit(1)), "_k").join(made.withColumn("_k", F.lit(1)), "_k")
    return one.select("true_pairs", "found", "made", "every", (F.col("found") / F.col("true_pairs")).alias("recall"), (1 - F.col("made") / F.col("every")).alias("reduction"))


def owners(scored: DataFrame) -> DataFrame:
    """The one edge of each candidate that greedy assignment can take, whatever the threshold."""
    return uncapped(scored.select("s1", "cid", "prob"))


def sweep(ids: DataFrame, truth: DataFrame, scored: DataFrame, taus: list[float]) -> DataFrame:
    """``(tau, f05)`` for each threshold in one job: the owner of a candidate is the same for all thresholds."""
    own = owners(scored)
    t = truth.select("s1", "cid").distinct().withColumn("t", F.lit(1))
    edges = own.join(t, ["s1", "cid"], "left").na.fill(0, ["t"])
    size = t.groupBy("s1").agg(F.count(F.lit(1)).alias("size"))
    marks = F.array(*map(F.lit, taus))
    per = edges.withColumn("tau", F.explode(F.filter(marks, lambda x: x <= F.col("prob")))).groupBy("s1", "tau").agg(F.count(F.lit(1)).alias("p"), F.sum("t").alias("tp"))
    grid = ids.select("s1").distinct().withColumn("tau", F.explode(marks))
    rows = grid.join(per, ["s1", "tau"], "left").join(size, "s1", "left").na.fill(0, ["p", "tp", "size"])
    return rows.groupBy("tau").agg(F.avg(f05(F.col("tp"), F.col("p"), F.col("size"))).alias("f05"))


def failures(ids: DataFrame, truth: DataFrame, links: DataFrame, scored: DataFrame, tau: Column | float) -> DataFrame:
    """``(s1, kind)`` of queries with F0.5 below a half: blocked, below_tau, lost, or false_match."""
    rows = per_query(ids, truth, links).where("f05 < 0.5")
    t = truth.select("s1", "cid").distinct()
    tau = F.lit(tau) if isinstance(tau, float) else tau
    found = t.join(scored.select("s1", "cid", "prob"), ["s1", "cid"]).groupBy("s1").agg(F.count(F.lit(1)).alias("found"), F.sum((F.col("prob") >= tau).cast("int")).alias("over"))
    rows = rows.join(found, "s1", "left").na.fill(0, ["found", "over"])
    kind = F.when(F.col("t") == 0, "false_match").when(F.col("found") == 0, "blocked").when(F.col("over") == 0, "below_tau").otherwise("lost")
    return rows.select("s1", kind.alias("kind"))


def misses(pairs: DataFrame) -> DataFrame:
    """``(s1, cid, kind)`` of missed true pairs with a_/b_ columns of basic() records."""
    a1, a2 = tx.tokens(F.col("a_addr_norm")), tx.tokens(F.col("b_addr_norm"))
    n1, n2 = tx.tokens(F.col("a_name_norm")), tx.tokens(F.col("b_name_norm"))
    kind = (
        F.when(tx.has_non_ascii(F.col("a_name_raw")) | tx.has_non_ascii(F.col("b_name_raw")), "script")
        .when((F.trim("a_addr_raw") == "") | (F.trim("b_addr_raw") == "") | ~F.coalesce(F.arrays_overlap(a1, a2), F.lit(False)), "address")
        .when(~F.coalesce(F.arrays_overlap(n1, n2), F.lit(False)), "name")
        .otherwise("other")
    )
    return pairs.select("s1", "cid", kind.alias("kind"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_prob, rate)``: predicted and true shares by equal parts of the scores (prob, label)."""
    cuts = scored.agg(F.percentile("prob", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("cuts"))
    rows = scored.join(F.broadcast(cuts))  # one row
    part = F.size(F.filter("cuts", lambda c: c < F.col("prob")))
    return rows.groupBy(part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg("label").alias("rate"))


def singleton_tau(scored: DataFrame, truth: DataFrame, share_: float = 0.95) -> DataFrame:
    """One row: the share's percentile of the best score among queries without a true link."""
    best = scored.groupBy("s1").agg(F.max("prob").alias("best"))
    return best.join(truth.select("s1").distinct(), "s1", "left_anti").agg(F.percentile("best", F.lit(share_)).alias("tau"))


#: Ranges of scores that running sums are taken in.
RANGES = 256


def auc(scored: DataFrame) -> DataFrame:
    """One row: area under the curve of (prob, label) by rank sums, ties sharing their ranks.

    Distinct scores are counted first. Their running sum is taken within ranges of scores, to
    which the sums of the lower ranges are added.
    """
    counts = scored.groupBy("prob").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    cuts = counts.agg(F.percentile_approx("prob", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000)).alias("cuts"))
    rows = counts.join(F.broadcast(cuts))  # one row
    rows = rows.select("prob", "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.size(F.filter("cuts", lambda c: c < F.col("prob"))).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lower = rows.groupBy("part").agg(F.sum("neg").alias("neg"))  # a row for each range
    lower = lower.select("part", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("lower"))
    within = Window.partitionBy("part").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(F.broadcast(lower), "part")
    wins = F.sum(F.col("pos") * (F.col("lower") + F.col("below") + F.col("neg") / 2))
    return rows.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))
