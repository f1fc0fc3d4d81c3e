"""Queries of decisions, assignment, guards, set and window forms, learning, and whole presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.text import quote
from ..operators import assign, audit, decide, guards, model
from ..operators import features as ft
from ..operators import vectorize as vz
from ..operators.tables import write_table
from . import config, normalize, pipeline
from .base import BASIC, REC, TRUTH, add, queries_of, records, truth
from .queries_blocking import COMPOSITE, UNION_SQL, chars_sql, matrix_sql, rows, two_channels, words_sql
from .queries_text import COUNTRY_CODE, WHOLE_SQL, state_of

TAUS = {"US": 0.30, "India": 0.25, "France": 0.35}
SC = UNION_SQL + ", sc AS (SELECT cand.s1, cid, n.country, round(score, 6) AS prob, rank FROM cand JOIN n ON n.doc = cand.s1)"


def scored(s: SparkSession, d: str) -> DataFrame:
    """The two-channel candidates with their country and score as prob."""
    country = records(s, d).select(F.col("entity_id").alias("s1"), "country")
    return write_table(two_channels(s, d).join(country, "s1").select("s1", "cid", "country", F.round("score", 6).alias("prob"), "rank"), "scored")


def edges(s, d):
    return scored(s, d).where("prob >= 0.2")


# -- decisions and assignment ------------------------------------------------------------------------
_TAU = "CASE country " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in TAUS.items()) + " ELSE 0.5 END"
add("dec1_threshold", lambda s, d: decide.above(scored(s, d), TAUS).select("s1", "cid", "prob"), SC + f" SELECT s1, cid, prob FROM sc WHERE prob >= {_TAU}")


def _rules(s, d):
    own = write_table(pipeline.normal_records(records(s, d), config.RULES), "rules")
    return pipeline.scored(own, config.RULES).select("s1", "cid", F.round("prob", 6).alias("prob"))


add("dec2_rule_engine", _rules)
_OWNER = "SELECT s1, cid, prob FROM sc WHERE prob >= 0.2 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1) = 1"
add("m2o1_uncapped", lambda s, d: assign.uncapped(edges(s, d)).select("s1", "cid", "prob"), f"{SC} {_OWNER}")
add("m2o2_capped", lambda s, d: assign.capped(edges(s, d), F.lit(2)))
add("m2o3_capped_by_source", lambda s, d: assign.capped_by_source(edges(s, d).withColumn("is_s3", F.col("cid").startswith("S3-").cast("int")), 2, 1))

# -- guards --------------------------------------------------------------------------------------------
FACTS = (
    f"f0 AS (SELECT entity_id, src, lower(trim(name)) AS name, trim(address) AS addr, {WHOLE_SQL} AS hn, {COUNTRY_CODE} AS pc0, {state_of(False)} AS state, "
    "list_distinct(regexp_extract_all(lower(trim(address)), '[\\p{L}\\p{N}_]+')) AS tokens FROM records), f AS (SELECT *, CASE WHEN pc0 = hn THEN '' ELSE pc0 END AS pc FROM f0)"
)
MATCHES = "m AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY cid) AS ord FROM truth)"
_PAIRED = "x AS (SELECT m.*, a.name AS an, a.addr AS aa, a.hn AS ah, a.pc AS ap, a.state AS ast, a.tokens AS ta, b.name AS bn, b.addr AS ba, b.hn AS bh, b.pc AS bp, b.state AS bst, b.tokens AS tb FROM m JOIN f a ON a.entity_id = s1 JOIN f b ON b.entity_id = cid)"
_PREMISE = "(ah <> '' AND bh <> '' AND ah <> bh AND NOT (contains(ba, ah) OR contains(aa, bh)))"
_POSTAL = "(ap <> '' AND bp <> '' AND ap <> bp)"
_LIKE = "(len(list_intersect(ta, tb)) / greatest(len(list_distinct(list_concat(ta, tb))), 1))"
_TIED = f"((ap <> '' AND ap = bp) OR CASE WHEN ast <> '' AND ast = bst THEN {_LIKE} >= 0.15 ELSE {_LIKE} >= 0.25 END)"
_CHAIN = f"(aa <> '' AND ba <> '' AND NOT {_TIED})"
_G = f"WITH {REC}, {TRUTH}, {FACTS}, {MATCHES}, {_PAIRED}"
_REASON = f"CASE WHEN {_PREMISE} THEN 'premise' WHEN {_POSTAL} THEN 'postal' WHEN {_CHAIN} THEN 'chain' END"


def matches(s, d) -> DataFrame:
    from pyspark.sql.window import Window

    return truth(records(s, d)).withColumn("ord", F.row_number().over(Window.partitionBy("s1").orderBy("cid")))


def facts(s, d) -> DataFrame:
    return write_table(normalize.hardening(records(s, d)), "facts")


def _guard(which):
    return lambda s, d: guards.with_facts(matches(s, d), facts(s, d)).select("s1", "cid", which().alias("conflict"))


def _weak(s, d):
    every = scored(s, d)
    return guards.weak_queries(every.where("prob >= 0.2"), every, 0.5).select("s1", "cid")


add("grd1_weak_queries", _weak, SC + " SELECT s1, cid FROM sc WHERE prob >= 0.2 AND s1 IN (SELECT s1 FROM sc GROUP BY s1 HAVING max(prob) >= 0.5)")


def _chain_zero(s, d):
    own = write_table(normalize.normalized(records(s, d)), "normal")
    both = ft.paired(scored(s, d).select("s1", "cid", "prob"), own.select("doc", "side", "name_clean", "addr_norm"))
    likeness = ft.sm.string_similarities(F.col("a_addr_norm"), F.col("b_addr_norm"), ("token_set_ratio",)).token_set_ratio
    return guards.chain_zero(both.withColumn("addr_token_set", likeness), guards.chain_names(own, 3)).select("s1", "cid", "prob")


add("grd2_chain_zero", _chain_zero)
add("grd3_premise", _guard(guards.premise_conflict), f"{_G} SELECT s1, cid, {_PREMISE} AS conflict FROM x")
add("grd4_postal", _guard(guards.postal_conflict), f"{_G} SELECT s1, cid, {_POSTAL} AS conflict FROM x")
add("grd5_chain", lambda s, d: guards.guarded(matches(s, d), facts(s, d), 1).select("s1", "cid", "reason"), f"{_G} SELECT s1, cid, {_REASON} AS reason FROM x")
add("grd6_marginal_singletons", lambda s, d: guards.marginal_singletons(guards.guarded(matches(s, d), facts(s, d))).select("s1", "cid", "reason"))


def _unknown(s, d):
    known = facts(s, d).where("src = 'S1' OR substring(entity_id, -1) <> '4'")
    return guards.guarded(matches(s, d), known, 1).where("reason IS NULL").select("s1", "cid")


add("grd7_unknown_kept", _unknown, f"{_G} SELECT s1, cid FROM x WHERE cid LIKE '%4' OR ({_REASON}) IS NULL")
_H, _P = "regexp_extract(trim(address), '^([0-9]+)', 1)", "coalesce(regexp_extract_all(address, '\\b([0-9]{5,6})\\b', 1)[-1], '')"
add(
    "grd8_cleanup",
    lambda s, d: guards.simple_cleanup(matches(s, d), records(s, d), 7).select("s1", "cid"),
    f"WITH {REC}, {TRUTH}, h AS (SELECT entity_id, {_H} AS h, {_P} AS p FROM records), k AS (SELECT s1 FROM truth GROUP BY s1 HAVING count(*) <= 7) "
    "SELECT s1, cid FROM truth JOIN h a ON a.entity_id = s1 JOIN h b ON b.entity_id = cid WHERE s1 IN (SELECT s1 FROM k) AND NOT (a.h <> '' AND b.h <> '' AND a.h <> b.h) AND NOT (a.p <> '' AND b.p <> '' AND a.p <> b.p)",
)
add(
    "grd9_telemetry",
    lambda s, d: guards.telemetry(guards.guarded(matches(s, d), facts(s, d), 1)),
    f"{_G} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM x GROUP BY ALL",
)
add("harden_all", lambda s, d: guards.harden(matches(s, d), facts(s, d)).select("s1", "cid", "reason"))

# -- windows, sets and joins ---------------------------------------------------------------------------
add("win1_rank", lambda s, d: scored(s, d).where("rank <= 3").select("s1", "cid", "rank"), SC + " SELECT s1, cid, rank FROM sc WHERE rank <= 3")
add("win2_truncate", lambda s, d: scored(s, d).where("rank <= 35").select("s1", "cid"), SC + " SELECT s1, cid FROM sc WHERE rank <= 35")
_CAP = "row_number() OVER (PARTITION BY s1, cid LIKE 'S3-%' ORDER BY ord, cid)"
add(
    "win3_degree_cap",
    lambda s, d: guards.degree_cap(matches(s, d).withColumn("reason", F.lit(None).cast("string")), 2, 1).where("reason IS NULL").select("s1", "cid"),
    f"WITH {REC}, {TRUTH}, {MATCHES} SELECT s1, cid FROM m QUALIFY {_CAP} <= CASE WHEN cid LIKE 'S3-%' THEN 1 ELSE 2 END",
)


def _place(s, d):
    return vz.top_k(scored(s, d).withColumnRenamed("prob", "score").withColumnRenamed("rank", "r0"), 1000).select("s1", "cid", "rank")


add("win4_order_by_score", _place, SC + " SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cid) AS rank FROM sc")


def _first_of_name(s, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("name").orderBy("id")
    return records(s, d).withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "name")


add("win5_first_of_each", _first_of_name, f"WITH {REC} SELECT id, name FROM records QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1")


def _side(s, d, which):
    return records(s, d).where(f"src = '{which}'").select("entity_id", "country")


add("set1_union_all", lambda s, d: _side(s, d, "S2").unionByName(_side(s, d, "S3")), f"WITH {REC} SELECT entity_id, country FROM records WHERE src = 'S2' UNION ALL SELECT entity_id, country FROM records WHERE src = 'S3'")
add("set2_union_distinct", lambda s, d: _side(s, d, "S2").union(truth(records(s, d)).join(records(s, d), F.col("cid") == F.col("entity_id")).select("cid", "country")).distinct(), f"WITH {REC}, {TRUTH} SELECT entity_id, country FROM records WHERE src = 'S2' UNION SELECT cid, country FROM truth JOIN records ON entity_id = cid")


def _names(s, d, which):
    return records(s, d).where(f"src = '{which}'").select(F.split("name", " ")[0].alias("word"))


_FIRST = "SELECT string_split(name, ' ')[1] AS word FROM records WHERE src = '{}'"
add("set3_intersect", lambda s, d: audit.shared_values(_names(s, d, "S1"), _names(s, d, "S2")), f"WITH {REC} {_FIRST.format('S1')} INTERSECT {_FIRST.format('S2')}")
add("set3_except", lambda s, d: audit.missing_values(_names(s, d, "S3"), _names(s, d, "S1")), f"WITH {REC} {_FIRST.format('S3')} EXCEPT {_FIRST.format('S1')}")
add("set4_drop_duplicates", lambda s, d: records(s, d).select("name", "country").dropDuplicates(), f"WITH {REC} SELECT DISTINCT name, country FROM records")
add(
    "set5_subset",
    lambda s, d: truth(records(s, d)).join(two_channels(s, d).select("s1", "cid"), ["s1", "cid"], "left_anti"),
    UNION_SQL + f", {TRUTH} SELECT s1, cid FROM truth WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.s1 = truth.s1 AND cand.cid = truth.cid)",
)
def _joins(s, d):
    q, t = queries_of(records(s, d)), truth(records(s, d))
    both = t.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    made = {"inner": q.join(both, "s1"), "left": q.join(both, "s1", "left"), "semi": q.join(t, "s1", "left_semi"), "anti": q.join(t, "s1", "left_anti")}
    out = None
    for kind, rows_ in made.items():
        n = F.coalesce("n", F.lit(0)) if kind in ("inner", "left") else F.lit(None)
        part = rows_.select(F.lit(kind).alias("kind"), "s1", n.cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


add(
    "join1_inner_left_semi_anti",
    _joins,
    f"WITH {REC}, {TRUTH}, q AS (SELECT entity_id AS s1 FROM records WHERE src = 'S1'), b AS (SELECT s1, count(*) AS n FROM truth GROUP BY s1) "
    "SELECT 'inner' AS kind, q.s1, n FROM q JOIN b ON b.s1 = q.s1 UNION ALL SELECT 'left', q.s1, coalesce(n, 0) FROM q LEFT JOIN b ON b.s1 = q.s1 "
    "UNION ALL SELECT 'semi', s1, NULL FROM q WHERE s1 IN (SELECT s1 FROM truth) UNION ALL SELECT 'anti', s1, NULL FROM q WHERE s1 NOT IN (SELECT s1 FROM truth)",
)
add(
    "join2_left_counts",
    lambda s, d: (lambda q, t: q.join(t.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "s1", "left").select("s1", F.coalesce("n", F.lit(0)).alias("n")))(queries_of(records(s, d)), truth(records(s, d))),
    f"WITH {REC}, {TRUTH} SELECT entity_id AS s1, count(cid) AS n FROM records LEFT JOIN truth ON truth.s1 = entity_id WHERE src = 'S1' GROUP BY ALL",
)

# -- score combinations -----------------------------------------------------------------------------------
def _combined(rule):
    def run(s, d):
        wide = scored(s, d)
        lexical = wide.where("rank <= 3").select("s1", "cid", F.col("prob").alias("score"))
        semantic = wide.where("rank <= 6").select("s1", "cid", F.round(1 - F.col("prob") / 2, 6).alias("sem"))
        aim = queries_of(records(s, d)).where("substring(s1, -1) IN ('0', '1')")
        return decide.combine(lexical, semantic, rule, aim).select("s1", "cid", F.round("score", 6).alias("score"))

    return run


_LS = SC + ", l AS (SELECT s1, cid, prob AS score FROM sc WHERE rank <= 3), e AS (SELECT s1, cid, round(1 - prob / 2, 6) AS sem FROM sc WHERE rank <= 6)"
_AIM = "right(s1, 1) IN ('0', '1')"
for _rule, _how, _new in (("a", "LEFT", "greatest(score, coalesce(sem, score))"), ("b", "FULL", "greatest(coalesce(score, sem), coalesce(sem, score))"), ("c", "LEFT", "0.6::DOUBLE * score + 0.4::DOUBLE * coalesce(sem, 0.0)")):
    add(
        f"com1_combine_{_rule}",
        _combined(_rule),
        f"{_LS}, b AS (SELECT coalesce(l.s1, e.s1) AS s1, coalesce(l.cid, e.cid) AS cid, score, sem FROM l {_how} JOIN e ON l.s1 = e.s1 AND l.cid = e.cid) "
        f"SELECT s1, cid, round(CASE WHEN {_AIM} THEN {_new} ELSE score END, 6) AS score FROM b WHERE {_AIM} OR score IS NOT NULL",
    )

# -- learning ------------------------------------------------------------------------------------------------
FEATURES = ("tfidf_word", "addr_jaccard", "name_word_jaccard", "name_containment", "addr_word_jaccard", "postal_match", "house_match", "name_len_ratio")


def examples(s, d) -> DataFrame:
    own = write_table(pipeline.normal_records(records(s, d), config.THREE_CHANNEL), "normal")
    pairs = model.label(pipeline.candidate_table(own, config.THREE_CHANNEL), truth(records(s, d)))
    return model.class_weight(write_table(pipeline.feature_rows(pairs, own, config.THREE_CHANNEL), "examples"))


add("ml1_stratified_sample", lambda s, d: audit.stratified(records(s, d).where("src = 'S1'"), ["country"], 50).select("entity_id", "country"))


def _binned(s, d):
    n = truth(records(s, d)).groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    own = records(s, d).where("src = 'S1'").join(n, F.col("entity_id") == F.col("s1"), "left").na.fill(0, ["n"])
    return own.select("entity_id", "country", audit.link_bin(F.col("n")).alias("bin")).groupBy("country", "bin").agg(F.count(F.lit(1)).alias("n"))


add(
    "ml2_link_bins",
    _binned,
    f"WITH {REC}, {TRUTH}, q AS (SELECT entity_id, country, count(cid) AS n FROM records LEFT JOIN truth ON s1 = entity_id WHERE src = 'S1' GROUP BY ALL) "
    "SELECT country, CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS bin, count(*) AS n FROM q GROUP BY ALL",
)
_T = ", t AS (SELECT DISTINCT s1, cid FROM truth)"
add(
    "ml3_labels",
    lambda s, d: model.label(scored(s, d).select("s1", "cid"), truth(records(s, d))),
    SC + f", {TRUTH}{_T} SELECT sc.s1, sc.cid, CASE WHEN t.cid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM sc LEFT JOIN t ON t.s1 = sc.s1 AND t.cid = sc.cid",
)
add("ml1_proportional_sample", lambda s, d: audit.proportional(records(s, d).where("src = 'S1'"), ["country"], 0.2, "entity_id").select("entity_id", "country"),
    f"WITH {REC}, q AS (SELECT entity_id, country, row_number() OVER (PARTITION BY country ORDER BY md5(entity_id), entity_id) AS k, count(*) OVER (PARTITION BY country) AS n FROM records WHERE src = 'S1') "
    "SELECT entity_id, country FROM q WHERE k <= ceil(0.2 * n)")  # fmt: skip
_HEX = "('0x' || substring(md5(s1 || '|' || cid), 1, 8))::BIGINT"
add("ml4_row_folds", lambda s, d: scored(s, d).select("s1", "cid", model.row_fold("s1", "cid").alias("fold")), SC + f" SELECT s1, cid, ({_HEX} % 5)::INT AS fold FROM sc")
add(
    "ml4_train_test_split",
    lambda s, d: scored(s, d).select("s1", "cid", (model.row_fold("s1", "cid", folds=10) < 8).alias("train")),
    SC + f" SELECT s1, cid, {_HEX} % 10 < 8 AS train FROM sc",
)
add("ml4_group_folds", lambda s, d: queries_of(records(s, d)).select("s1", model.fold(F.col("s1"), 5).alias("fold")))


def _trained(two_pass):
    def run(s, d):
        rows_ = model.cross_validated(examples(s, d), FEATURES, two_pass=two_pass)
        return rows_.select("s1", "cid", "fold", "label", F.round("prob", 6).alias("prob"))

    return run


add("ml5_boosted_trees", _trained(False))
add("ml6_two_pass", _trained(True))
add(
    "ml7_hard_negatives",
    lambda s, d: model.hard_negatives(scored(s, d), truth(records(s, d)), 5),
    SC + f", {TRUTH}{_T} SELECT sc.s1, sc.cid, rank, CASE WHEN t.cid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM sc LEFT JOIN t ON t.s1 = sc.s1 AND t.cid = sc.cid WHERE rank <= 5 "
    "UNION ALL SELECT s1, cid, 1, 1.0::DOUBLE FROM t WHERE NOT EXISTS (SELECT 1 FROM sc WHERE rank <= 5 AND sc.s1 = t.s1 AND sc.cid = t.cid)",
)


def _negatives(s, d):
    own = records(s, d).select(F.col("entity_id").alias("doc"), F.col("src").alias("side"), "country")
    return model.sampled_negatives(own, truth(records(s, d)), 3)


add("ml7_sampled_negatives", _negatives)


def _calibrated(how):
    def run(s, d):
        own = model.label(scored(s, d), truth(records(s, d)))
        return how(own).select("s1", "cid", F.round("calibrated", 6).alias("calibrated"))

    return run


add("ml9_platt", _calibrated(model.platt))
add("ml9_isotonic", _calibrated(model.isotonic))


def _importance(s, d):
    fitted = model.fit(examples(s, d), FEATURES)
    path = write_table(s.range(1), "model")._path + "-model"
    fitted.write().overwrite().save(path)
    again = type(fitted).load(path)
    return s.createDataFrame(model.importance(again, FEATURES), "feature string, gain double")


add("ml10_importance_and_reload", _importance)
add("ml11_fold_summary", lambda s, d: model.fold_summary(write_table(_trained(False)(s, d), "folds"), 0.5))


# -- whole presets -----------------------------------------------------------------------------------------------
def _resolved(preset, **options):
    def run(s, d):
        own = write_table(records(s, d), "records")
        fitted = pipeline.train(own, truth(own), preset) if preset.score == "model" else None
        return pipeline.resolve(own, preset, fitted, **options).select("s1", "cid", F.round("prob", 6).alias("prob"), "ord")

    return run


_BASE = (
    SC + ", o AS (SELECT s1, cid, prob FROM sc WHERE prob >= 0.5 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1) = 1) "
    "SELECT s1, cid, prob, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cid) AS ord FROM o"
)


def _resolve_baseline(s, d):
    from dataclasses import replace

    from .queries_blocking import SET, WORD

    channels = (config.Channel("term", "word", "both", WORD, 30), config.Channel("set", "addr", "address", SET, 30))
    return _resolved(replace(config.BASELINE, channels=channels), tau=0.5)(s, d)


add("resolve_baseline", _resolve_baseline, _BASE)
_SUFFIX = f"n AS (SELECT entity_id AS doc, src AS side, country, {tx.NAME_SUFFIXES.sql('name')} AS name_norm, {tx.ADDRESS.sql('address')} AS addr_norm FROM records)"
_PLACE = "row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cid) AS ord"


def _vectors(preset: config.Preset) -> tuple:
    return tuple(c.vectorizer for c in preset.channels)


def _pair_sql(normal: str, one: str, two: str, score: str, cap: int) -> str:
    """Candidates of two channels ca and cb with a score, the best ``cap`` of a query by the greater."""
    return (
        f"WITH {REC}, {normal}, {one}, {two}, u AS (SELECT coalesce(ca.s1, cb.s1) AS s1, coalesce(ca.cid, cb.cid) AS cid, coalesce(ca.score, 0.0) AS x, coalesce(cb.score, 0.0) AS y "
        f"FROM ca FULL JOIN cb ON ca.s1 = cb.s1 AND ca.cid = cb.cid), r AS (SELECT s1, cid, round({score}, 6) AS prob FROM u QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(greatest(x, y), 9) DESC, cid) <= {cap})"
    )


RESOLVED_SQL = {
    "sprint0": f"WITH {REC}, {_SUFFIX}, {matrix_sql('ca', chars_sql('name_norm', 3, 5), *_vectors(config.SPRINT0), 30)}, r AS (SELECT s1, cid, round(score, 6) AS prob FROM ca) SELECT s1, cid, prob, {_PLACE} FROM r WHERE prob >= 0.5",
    "sprint0v2": _pair_sql(
        _SUFFIX, matrix_sql("ca", words_sql("name_norm"), _vectors(config.SPRINT0V2)[0], 30), matrix_sql("cb", words_sql("addr_norm"), _vectors(config.SPRINT0V2)[1], 30), "0.55::DOUBLE * x + 0.45::DOUBLE * y", 30
    )
    + f" SELECT s1, cid, prob, {_PLACE} FROM r WHERE prob >= 0.5",
    "sprint1": f"WITH {REC}, {BASIC}, {matrix_sql('ca', words_sql(COMPOSITE), *_vectors(config.SPRINT1), 35)}, r AS (SELECT s1, cid, round(score, 6) AS prob FROM ca) SELECT s1, cid, prob, {_PLACE} FROM r WHERE prob >= 0.6",
}
add(
    "resolve_baseline_preset",
    _resolved(config.BASELINE),
    _pair_sql(BASIC, matrix_sql("ca", words_sql(COMPOSITE), _vectors(config.BASELINE)[0], 30), matrix_sql("cb", words_sql("addr_norm"), _vectors(config.BASELINE)[1], 30), "greatest(x, y)", 50)
    + f", o AS (SELECT * FROM r WHERE prob >= 0.8 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1) = 1) SELECT s1, cid, prob, {_PLACE} FROM o",
)
for _p in config.PRESETS.values():
    if _p.name != "baseline":
        add(f"resolve_{_p.name}", _resolved(_p), RESOLVED_SQL.get(_p.name))

__all__ = ["FEATURES", "SC", "edges", "examples", "facts", "fixed", "matches", "quote", "rows", "scored"]
