"""Queries of sources and sinks, metrics, audits and validators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit, guards, metrics, model, validate
from ..operators import features as ft
from ..operators.tables import shared_folder, write_table
from ..sources import files
from . import normalize
from .base import REC, TRUTH, add, queries_of, records, table, truth
from .queries_blocking import two_channels
from .queries_links import FACTS, SC, edges, examples, matches, scored


def _path(s, tag):
    return f"{shared_folder(s)}/er-{tag}-{uuid.uuid4().hex}"


def tsv(s, d, header=True):
    """The records as one tab-separated file."""
    path = _path(s, "tsv")
    rows = records(s, d).select("id", "entity_id", F.col("name").alias("business_name"), F.col("address").alias("business_address"), "country")
    files.write_tsv(rows, path, "id")
    return path


_COLS = "entity_id, name AS business_name, address AS business_address, country"
add("src1_tsv_scan", lambda s, d: files.read_tsv(s, tsv(s, d)), f"WITH {REC} SELECT {_COLS} FROM records")
add("src2_pruned_scan", lambda s, d: files.read_tsv(s, tsv(s, d)).select("entity_id", "country"), f"WITH {REC} SELECT entity_id, country FROM records")
add("src3_needed_ids", lambda s, d: files.read_needed(s, tsv(s, d), records(s, d).where("id % 7 = 0").select("entity_id")), f"WITH {REC} SELECT {_COLS} FROM records WHERE id % 7 = 0")
add("src4_head", lambda s, d: files.head(records(s, d).select("id", "name"), 20, "id"), f"WITH {REC} SELECT id, name FROM records ORDER BY id LIMIT 20")
add(
    "src5_inspect",
    lambda s, d: files.inspect(s, f"{d}/customer.parquet").select("column", "rows", "nulls"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
)
add(
    "src6_raw_lines",
    lambda s, d: files.read_lines(s, tsv(s, d), ("a", "b", "c")).where("a <> 'entity_id'"),
    f"WITH {REC} SELECT entity_id AS a, name AS b, address AS c FROM records",
)
_ORD = "row_number() OVER (PARTITION BY s1 ORDER BY cid)"


def lists(s, d, links=None):
    s1 = records(s, d).where("src = 'S1'").select("entity_id", F.col("id").alias("ord"))
    return files.listed(s1, matches(s, d) if links is None else links, ["ord"])


_LISTED = "SELECT id AS ord, entity_id AS source1_entity_id, coalesce(l, '') AS {name} FROM records LEFT JOIN ({links}) x ON x.s1 = entity_id WHERE src = 'S1'"
_TRUE_LISTS = _LISTED.format(name="matched_entity_ids", links="SELECT s1, string_agg(cid, ',' ORDER BY cid) AS l FROM truth GROUP BY s1")
add(
    "src7_id_lists",
    lambda s, d: files.explode_ids(lists(s, d), *files.LINKS).withColumnRenamed(files.LINKS[0], "s1"),
    f"WITH {REC}, {TRUTH} SELECT s1, cid, CAST({_ORD} - 1 AS INT) AS ord FROM truth",
)


def _claims(s, d):
    path = _path(s, "claims")
    files.write_claims(scored(s, d).withColumn("is_s3", F.col("cid").startswith("S3-").cast("double")), path)
    return files.read_claims(s, path)


add("src8_claim_shards", _claims, SC + " SELECT s1, cid, (cid LIKE 'S3-%')::INT::DOUBLE AS is_s3, prob FROM sc")
_INDEXED = SC + ", i AS (SELECT entity_id, CAST(id AS INT) AS k FROM records)"


def _shards(form):
    def run(s, d):
        path = _path(s, form)
        place = records(s, d).select(F.col("entity_id"), F.col("id").cast("int").alias("k"))
        own = scored(s, d).join(place.withColumnsRenamed({"entity_id": "s1", "k": "s1_index"}), "s1").join(place.withColumnsRenamed({"entity_id": "cid", "k": "corpus_index"}), "cid")
        files.write_shards(own.withColumn("is_s3", F.col("cid").startswith("S3-").cast("double")), path, form)
        return files.read_shards(s, path, form)

    return run


add("src8_claim_shards_v1", _shards("v1"), _INDEXED + " SELECT i.k AS s1_index, cid, round(prob, 4) AS prob FROM sc JOIN i ON i.entity_id = s1")
add("src8_claim_shards_v2", _shards("v2"), _INDEXED + " SELECT i.k AS s1_index, cid, j.k AS corpus_index, round(prob, 4) AS prob FROM sc JOIN i ON i.entity_id = s1 JOIN i j ON j.entity_id = cid")
add("src8_claim_shards_rules", _shards("rules"), _INDEXED + " SELECT i.k AS s1_index, cid, round(prob, 4) AS prob FROM sc JOIN i ON i.entity_id = s1")
add("src8_candidate_shards", _shards("candidates"), SC + " SELECT s1, cid FROM sc")
add("src9_table_checkpoint", lambda s, d: write_table(records(s, d).select("id", "name"), "again"), f"WITH {REC} SELECT id, name FROM records")
add(
    "src10_vector_store",
    lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("size"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("head")),
    "SELECT vec_id AS id, len(embedding)::INT AS size, round(embedding[1]::DOUBLE, 5) AS head FROM embeddings",
)
add("snk1_matching_lists", lists, f"WITH {REC}, {TRUTH} {_TRUE_LISTS}")
add(
    "snk2_candidate_lists",
    lambda s, d: files.listed(records(s, d).where("src = 'S1'").select("entity_id", F.col("id").alias("ord")), scored(s, d), ["rank"], files.CANDIDATES[1]),
    SC + " " + _LISTED.format(name="candidate_entity_ids", links="SELECT s1, string_agg(cid, ',' ORDER BY rank) AS l FROM sc GROUP BY s1"),
)


def _zipped(s, d):
    """The result lists as a zip's one entry, read again line by line."""
    import tempfile

    own = lists(s, d)
    with tempfile.TemporaryDirectory() as folder:
        out = f"{folder}/submission.zip"
        files.zip_rows(own, out, "matching_results.tsv")
        found = files.zip_entries(out)
    return s.createDataFrame(found, "name string, lines long")


add("snk5_zip", _zipped, f"WITH {REC} SELECT 'matching_results.tsv' AS name, count(*) + 1 AS lines FROM records WHERE src = 'S1'")


def _meta(s, d):
    import tempfile

    counts = {r.src: r.n for r in records(s, d).groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    with tempfile.TemporaryDirectory() as folder:
        files.write_meta({"rows": counts, "taus": [0.5, 0.65]}, f"{folder}/meta.json")
        again = files.read_meta(f"{folder}/meta.json")
    return s.createDataFrame([(k, int(v), again["taus"][1]) for k, v in sorted(again["rows"].items())], "src string, n long, tau double")


add("snk6_json_meta", _meta, f"WITH {REC} SELECT src, count(*) AS n, 0.65::DOUBLE AS tau FROM records GROUP BY src")


def _parts(s, d):
    path = _path(s, "parts")
    files.write_parts(records(s, d).select("entity_id", "country"), path)
    return s.read.parquet(path).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


add("snk3_country_parts", _parts, f"WITH {REC} SELECT country, count(*) AS n FROM records GROUP BY country")
add(
    "snk4_assemble",
    lambda s, d: files.assemble(records(s, d).where("src = 'S1'").select("entity_id", F.col("id").alias("ord")), lists(s, d).drop("ord").where("matched_entity_ids <> ''")),
    f"WITH {REC}, {TRUTH} {_TRUE_LISTS}",
)
add("snk4_duplicate_claims", lambda s, d: files.duplicate_claims(lists(s, d)), f"WITH {REC}, {TRUTH} SELECT cid, count(*) AS n FROM truth GROUP BY cid HAVING count(*) > 1")

# -- aggregates ----------------------------------------------------------------------------------------------
add(
    "agg1_profile",
    lambda s, d: audit.profile(records(s, d)).withColumn("mean", F.round("mean", 6)),
    f"WITH {REC} SELECT src, country, count(*) AS rows, count(DISTINCT entity_id) AS ids, count(DISTINCT name) AS names, count(*) - count(DISTINCT name) AS repeated, count(*) FILTER (WHERE address = '') AS missing, "
    "min(length(address))::INT AS shortest, quantile_cont(length(address), 0.5)::DOUBLE AS median, round(avg(length(address)), 6) AS mean, max(length(address))::INT AS longest FROM records GROUP BY src, country",
)
add(
    "agg2_link_histogram",
    lambda s, d: audit.link_histogram(queries_of(records(s, d)), truth(records(s, d))),
    f"WITH {REC}, {TRUTH}, p AS (SELECT entity_id, count(cid) AS links, count(*) FILTER (WHERE cid LIKE 'S2-%') AS s2, count(*) FILTER (WHERE cid LIKE 'S3-%') AS s3 FROM records LEFT JOIN truth ON s1 = entity_id WHERE src = 'S1' GROUP BY ALL) "
    "SELECT links, count(*) AS queries, sum(s2)::BIGINT AS s2, sum(s3)::BIGINT AS s3 FROM p GROUP BY links",
)
add("agg2_most_frequent", lambda s, d: audit.most_frequent(table(s, d, "part"), "p_name"), "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 5")
add(
    "agg3_name_frequency",
    lambda s, d: guards.name_frequency(normalize.hardening(records(s, d)), matches(s, d)),
    f"WITH {REC}, {TRUTH}, {FACTS} SELECT name, count(*) AS freq FROM f WHERE name <> '' AND (src = 'S1' OR entity_id IN (SELECT cid FROM truth)) GROUP BY name",
)
add("agg4_best_score", lambda s, d: scored(s, d).groupBy("s1").agg(F.max("prob").alias("best")), SC + " SELECT s1, max(prob) AS best FROM sc GROUP BY s1")
_LAB = f", {TRUTH}, lab AS (SELECT sc.*, CASE WHEN t.cid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM sc LEFT JOIN (SELECT DISTINCT s1, cid FROM truth) t ON t.s1 = sc.s1 AND t.cid = sc.cid)"


def labelled(s, d):
    return model.label(scored(s, d), truth(records(s, d)))


add(
    "agg5_reliability",
    lambda s, d: metrics.reliability(labelled(s, d)).select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), F.round("rate", 6).alias("rate")),
    SC + _LAB + ", q AS (SELECT quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM lab) "
    "SELECT len(list_filter(cuts, lambda c: c < prob))::INT AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS rate FROM lab, q GROUP BY 1",
)
add(
    "agg6_singleton_threshold",
    lambda s, d: metrics.singleton_tau(scored(s, d), truth(records(s, d))).select(F.round("tau", 6).alias("tau")),
    SC + f", {TRUTH}, b AS (SELECT s1, max(prob) AS best FROM sc WHERE s1 NOT IN (SELECT s1 FROM truth) GROUP BY s1) SELECT round(quantile_cont(best, 0.95), 6) AS tau FROM b",
)
add("agg7_ordered_lists", lambda s, d: lists(s, d, scored(s, d).withColumn("ord", F.col("rank"))), SC + " " + _LISTED.format(name="matched_entity_ids", links="SELECT s1, string_agg(cid, ',' ORDER BY rank) AS l FROM sc GROUP BY s1"))
add(
    "agg8_blocking_recall",
    lambda s, d: metrics.blocking_recall(truth(records(s, d)), two_channels(s, d), records(s, d)).withColumn("recall", F.round("recall", 6)).withColumn("reduction", F.round("reduction", 6)),
    SC + f", {TRUTH}, a AS (SELECT count(*) AS true_pairs, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sc WHERE sc.s1 = truth.s1 AND sc.cid = truth.cid)) AS found FROM truth), "
    "e AS (SELECT sum(x * y)::BIGINT AS every FROM (SELECT country, count(*) FILTER (WHERE src = 'S1') AS x, count(*) FILTER (WHERE src <> 'S1') AS y FROM records GROUP BY country) z), m AS (SELECT count(*) AS made FROM sc) "
    "SELECT true_pairs, found, made, every, round(found / true_pairs, 6) AS recall, round(1 - made / every, 6) AS reduction FROM a, e, m",
)
PER = (
    f", {TRUTH}, l AS (SELECT s1, cid FROM sc WHERE prob >= 0.2 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1) = 1), "
    "j AS (SELECT coalesce(t.s1, l.s1) AS s1, t.cid AS tc, l.cid AS lc FROM (SELECT DISTINCT s1, cid FROM truth) t FULL JOIN l ON l.s1 = t.s1 AND l.cid = t.cid), "
    "k AS (SELECT entity_id AS s1, count(tc) AS t, count(lc) AS p, count(*) FILTER (WHERE tc IS NOT NULL AND lc IS NOT NULL) AS tp FROM records LEFT JOIN j ON j.s1 = entity_id WHERE src = 'S1' GROUP BY entity_id), "
    "per AS (SELECT *, CASE WHEN p = 0 AND t = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE tp / p END AS precision, CASE WHEN p = 0 AND t = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE tp / t END AS recall, "
    "CASE WHEN p = 0 AND t = 0 THEN 1.0 WHEN p = 0 OR t = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / p) * (tp / t) / (0.25 * (tp / p) + tp / t) END::DOUBLE AS f05 FROM k)"
)


def linked(s, d):
    from ..operators.assign import uncapped

    return uncapped(edges(s, d)).select("s1", "cid", "prob")


def _macro(s, d):
    out = metrics.macro(queries_of(records(s, d)), truth(records(s, d)), linked(s, d))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")))


add("agg9_macro_f05", _macro, SC + PER + " SELECT count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f05), 6) AS f05 FROM per")


def _micro(s, d):
    out = metrics.micro(truth(records(s, d)), linked(s, d))
    return out.select("t", "p", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")))


add(
    "agg10_micro_f05",
    _micro,
    SC + PER + ", s_ AS (SELECT count(tc) AS t, count(lc) AS p, count(*) FILTER (WHERE tc IS NOT NULL AND lc IS NOT NULL) AS tp FROM j) "
    "SELECT t, p, tp, round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(1.25 * (tp / p) * (tp / t) / (0.25 * (tp / p) + tp / t), 6) AS f05 FROM s_",
)


def _counts(s, d):
    out = metrics.macro(queries_of(records(s, d)), truth(records(s, d)), linked(s, d))
    return out.select("perfect", "zero", "part", F.round("median", 6).alias("median"))


add(
    "agg11_entity_counts",
    _counts,
    SC + PER + " SELECT count(*) FILTER (WHERE f05 = 1) AS perfect, count(*) FILTER (WHERE f05 = 0) AS zero, count(*) FILTER (WHERE f05 > 0 AND f05 < 1) AS part, round(quantile_cont(f05, 0.5), 6) AS median FROM per",
)
add(
    "agg12_failures",
    lambda s, d: metrics.failures(queries_of(records(s, d)), truth(records(s, d)), linked(s, d), scored(s, d), 0.2),
    SC + PER + ", fd AS (SELECT t.s1, count(*) AS found, count(*) FILTER (WHERE prob >= 0.2) AS over FROM (SELECT DISTINCT s1, cid FROM truth) t JOIN sc ON sc.s1 = t.s1 AND sc.cid = t.cid GROUP BY t.s1) "
    "SELECT per.s1, CASE WHEN t = 0 THEN 'false_match' WHEN coalesce(found, 0) = 0 THEN 'blocked' WHEN over = 0 THEN 'below_tau' ELSE 'lost' END AS kind FROM per LEFT JOIN fd ON fd.s1 = per.s1 WHERE f05 < 0.5",
)


def _misses(s, d):
    missed = truth(records(s, d)).join(two_channels(s, d).select("s1", "cid"), ["s1", "cid"], "left_anti")
    return metrics.misses(ft.paired(missed, normalize.basic(records(s, d))))


_TOK = "list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')"
add(
    "agg13_misses",
    _misses,
    SC + f", {TRUTH}, x AS (SELECT s1, cid FROM truth WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = truth.s1 AND sc.cid = truth.cid)) "
    "SELECT s1, cid, CASE WHEN regexp_matches(a.name_raw, '[^\\x00-\\x7F]') OR regexp_matches(b.name_raw, '[^\\x00-\\x7F]') THEN 'script' "
    f"WHEN trim(a.addr_raw) = '' OR trim(b.addr_raw) = '' OR NOT list_has_any({_TOK.format('a.addr_norm')}, {_TOK.format('b.addr_norm')}) THEN 'address' "
    f"WHEN NOT list_has_any({_TOK.format('a.name_norm')}, {_TOK.format('b.name_norm')}) THEN 'name' ELSE 'other' END AS kind FROM x JOIN n a ON a.doc = s1 JOIN n b ON b.doc = cid",
)
add(
    "agg14_auc",
    lambda s, d: metrics.auc(labelled(s, d)).select(F.round("auc", 6).alias("auc")),
    SC + _LAB + ", r AS (SELECT label, (rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0) AS rk FROM lab) "
    "SELECT round((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r",
)
TAUS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
add(
    "ml8_threshold_sweep",
    lambda s, d: metrics.sweep(queries_of(records(s, d)), truth(records(s, d)), scored(s, d), TAUS).select("tau", F.round("f05", 6).alias("f05")),
    SC + f", {TRUTH}, g AS (SELECT unnest({TAUS})::DOUBLE AS tau), t AS (SELECT DISTINCT s1, cid FROM truth), o AS (SELECT s1, cid, prob FROM sc QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1) = 1), "
    "e AS (SELECT o.s1, prob, t.cid IS NOT NULL AS hit FROM o LEFT JOIN t ON t.s1 = o.s1 AND t.cid = o.cid), z AS (SELECT s1, count(*) AS size FROM t GROUP BY s1), "
    "k AS (SELECT tau, entity_id AS s1, coalesce(any_value(size), 0) AS t, count(e.s1) AS p, count(e.s1) FILTER (WHERE hit) AS tp FROM g CROSS JOIN records LEFT JOIN e ON e.s1 = entity_id AND e.prob >= tau LEFT JOIN z ON z.s1 = entity_id WHERE src = 'S1' GROUP BY tau, entity_id) "
    "SELECT tau, round(avg(CASE WHEN p = 0 AND t = 0 THEN 1.0 WHEN p = 0 OR t = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / p) * (tp / t) / (0.25 * (tp / p) + tp / t) END::DOUBLE), 6) AS f05 FROM k GROUP BY tau",
)
add(
    "audit_source_overlap",
    lambda s, d: audit.source_overlap(records(s, d).withColumn("name", F.split("name", " ")[0]), "name"),
    f"WITH {REC}, g AS (SELECT string_split(name, ' ')[1] AS w, max((src = 'S1')::INT) AS x, max((src = 'S2')::INT) AS y, max((src = 'S3')::INT) AS z FROM records GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum({p} * {q})::BIGINT AS both, sum({p} * (1 - {q}))::BIGINT AS only_a, sum({q} * (1 - {p}))::BIGINT AS only_b FROM g" for a, b, p, q in (("S1", "S2", "x", "y"), ("S1", "S3", "x", "z"), ("S2", "S3", "y", "z"))),
)


# -- validators -----------------------------------------------------------------------------------------------
def _broken(s, d):
    """Result rows with one of each fault."""
    own = lists(s, d).drop("ord")
    last = own.where("source1_entity_id = 'S1-000000020'")
    bad = F.when(F.col("source1_entity_id") == "S1-000000010", F.lit("S2-000000013,S2-000000013,S1-000000011,X9-1,S2-999999999")).otherwise(F.col("matched_entity_ids"))
    kept = own.where("source1_entity_id <> 'S1-000000030'").withColumn("matched_entity_ids", bad)
    extra = last.select(F.lit("S1-999999999").alias("source1_entity_id"), "matched_entity_ids")
    return kept.unionByName(last).unionByName(extra)


def _val1(s, d):
    path = _path(s, "bad")
    lines = s.createDataFrame([("id,matched_entity_ids",), ("S1-1\tS2-1",), ("S1-2",), ("S1-3\tS2-�",)], "value string")
    lines.coalesce(1).write.text(path)
    return validate.check_lines(s, path, files.LINKS).select("check", "severity", "n")


add("val1_lines", _val1, "SELECT * FROM (VALUES ('header', 'error', 1::BIGINT), ('csv', 'error', 0), ('no_tab', 'error', 2), ('utf8', 'error', 1)) t(\"check\", severity, n)")
add(
    "val2_links",
    lambda s, d: validate.check_links(_broken(s, d), records(s, d).where("src = 'S1'"), records(s, d).where("src <> 'S1'")),
    f"WITH {REC}, {TRUTH}, e AS (SELECT count(*) AS n FROM records WHERE src = 'S1' AND entity_id NOT IN (SELECT s1 FROM truth)), "
    "x AS (SELECT string_agg(v, ',' ORDER BY v) AS v FROM (SELECT entity_id AS v FROM records WHERE src = 'S1' AND entity_id NOT IN (SELECT s1 FROM truth) ORDER BY entity_id LIMIT 5) t) "
    "SELECT 'duplicate_row' AS \"check\", 'error' AS severity, 1::BIGINT AS n, 'S1-000000020' AS examples UNION ALL SELECT 'duplicate_id', 'error', 1, 'S1-000000010:S2-000000013' "
    "UNION ALL SELECT 'query_as_match', 'error', 1, 'S1-000000010:S1-000000011' UNION ALL SELECT 'prefix', 'error', 1, 'S1-000000010:X9-1' UNION ALL SELECT 'missing_row', 'error', 1, 'S1-000000030' "
    "UNION ALL SELECT 'extra_row', 'error', 1, 'S1-999999999' UNION ALL SELECT 'empty', 'info', e.n, x.v FROM e, x "
    "UNION ALL SELECT 'unknown_id', 'error', 3, 'S1-000000010:S1-000000011,S1-000000010:S2-999999999,S1-000000010:X9-1'",
)
add(
    "val3_subset",
    lambda s, d: validate.check_subset(truth(records(s, d)), two_channels(s, d)).select("check", "severity", "n"),
    SC + f", {TRUTH} SELECT 'not_candidate' AS \"check\", 'warning' AS severity, count(*) AS n FROM truth WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = truth.s1 AND sc.cid = truth.cid)",
)
add(
    "val4_table",
    lambda s, d: validate.check_table(lists(s, d), records(s, d).where("src = 'S1'").select(F.col("id").alias("ord"), F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", ["ord", *files.LINKS]),
    f"WITH {REC} SELECT count(*) AS rows, count(*) AS expected, 0::BIGINT AS bad, 0::BIGINT AS moved, true AS columns FROM records WHERE src = 'S1'",
)
add(
    "val5_counts",
    lambda s, d: lists(s, d).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source1_entity_id").alias("ids")),
    f"WITH {REC} SELECT count(*) AS rows, count(DISTINCT entity_id) AS ids FROM records WHERE src = 'S1'",
)
add("val6_duplicate_assignments", lambda s, d: validate.duplicate_assignments(truth(records(s, d))), f"WITH {REC}, {TRUTH} SELECT cid, count(DISTINCT s1) AS n FROM truth GROUP BY cid HAVING count(DISTINCT s1) > 1")


def _gate(s, d):
    r = metrics.blocking_recall(truth(records(s, d)), two_channels(s, d), records(s, d)).select("recall", F.lit(1).alias("k"))
    f = metrics.macro(queries_of(records(s, d)), truth(records(s, d)), linked(s, d)).select("f05", F.lit(1).alias("k"))
    return validate.gate(r.join(f, "k"), *FLOORS).select(F.round("recall", 6).alias("recall"), F.round("f05", 6).alias("f05"), "passed")


#: Blocking recall and F0.5 that a change must beat.
FLOORS = (0.8997, 0.6636)
add(
    "val7_gate",
    _gate,
    SC + PER + ", r AS (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sc WHERE sc.s1 = truth.s1 AND sc.cid = truth.cid)) / count(*) AS recall FROM truth), g AS (SELECT avg(f05) AS f05 FROM per) "
    f"SELECT round(recall, 6) AS recall, round(f05, 6) AS f05, recall > {FLOORS[0]} AND f05 > {FLOORS[1]} AS passed FROM r, g",
)
__all__ = ["examples", "linked", "tsv"]
