"""Queries of vectorizers, channels, unions and neighbours."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as ad
from ..functions import fixed
from ..functions import similarity as sm
from ..functions import text as tx
from ..operators import blocking, knn, sparse
from ..operators import features as ft
from ..operators import vectorize as vz
from ..operators.tables import write_table
from ..sources.records import entities
from . import config, normalize, pipeline
from .base import BASIC, EMBEDDED, REC, add, joined, records, table
from .queries_text import rule_sql

WORD = vz.Vectorizer(2, 0.02, 150_000, 1000)
SET = vz.Vectorizer(2, 0.04, 100_000, 1000, binary=True)
CHAR = vz.Vectorizer(2, 0.05, 80_000, 1000)
COMPOSITE = "trim(name_norm || ' ' || name_norm || ' ' || addr_norm)"


def words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def chars_sql(x: str, low: int, high: int) -> str:
    parts = [f"CASE WHEN length(w) < {low} THEN [w] ELSE [] END"]
    parts += [f"CASE WHEN length(w) >= {n} THEN list_transform(generate_series(1, length(w) - {n - 1}), lambda i: substring(w, i, {n})) ELSE [] END" for n in range(low, high + 1)]
    body = parts[0]
    for p in parts[1:]:
        body = f"list_concat({body}, {p})"
    return f"flatten(list_transform(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> ''), lambda t: list_transform([' ' || t || ' '], lambda w: {body})[1]))"


def weights_sql(terms: str, v: vz.Vectorizer, at: str = "n") -> str:
    """CTEs c, s, v and w of a matrix."""
    raw = "1.0::DOUBLE" if v.binary else "(1 + ln(tf)) * (ln((1 + v.n) / (1 + v.df)) + 1)"
    scaled = "w" if v.binary else "w / sqrt(sum(w * w) OVER (PARTITION BY doc))"
    return f"""c AS (SELECT country, doc, side, term, count(*) AS tf FROM (SELECT country, doc, side, unnest({terms}) AS term FROM {at}) t GROUP BY ALL),
s AS (SELECT country, count(*) AS n FROM {at} GROUP BY country),
v AS (SELECT * FROM (SELECT c.country, term, count(*) AS df, sum(tf) AS cf, any_value(s.n) AS n FROM c JOIN s ON c.country = s.country GROUP BY c.country, term) x
  WHERE df >= {v.min_df} AND df <= least(CASE WHEN n < {v.small} THEN greatest({v.max_df}::DOUBLE, 10.0::DOUBLE / n) ELSE {v.max_df}::DOUBLE END, 1.0::DOUBLE) * n
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY cf DESC, term) <= {v.max_features}),
w AS (SELECT country, doc, side, term, {scaled} AS w FROM (SELECT c.country, doc, side, c.term, {raw} AS w FROM c JOIN v ON c.country = v.country AND c.term = v.term) y)"""


PRODUCT = "p AS (SELECT a.country, a.doc AS s1, b.doc AS cid, sum(a.w * b.w) AS score FROM w a JOIN w b ON a.country = b.country AND a.term = b.term WHERE a.side = 'S1' AND b.side <> 'S1' GROUP BY ALL)"
JACCARD = PRODUCT.replace("p AS", "o AS") + ", z AS (SELECT doc, count(*) AS k FROM w GROUP BY doc), p AS (SELECT o.country, s1, cid, score / (x.k + y.k - score) AS score FROM o JOIN z x ON x.doc = s1 JOIN z y ON y.doc = cid)"


def top_sql(k: int) -> str:
    return f"SELECT s1, cid, score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cid) AS rank FROM p QUALIFY rank <= {k}"


def channel_sql(terms: str, v: vz.Vectorizer, k: int) -> str:
    return f"WITH {REC}, {BASIC}, {weights_sql(terms, v)}, {JACCARD if v.binary else PRODUCT} SELECT s1, cid, round(score, 6) AS score FROM ({top_sql(k)}) t"


def rows(s: SparkSession, d: str) -> DataFrame:
    return write_table(normalize.basic(records(s, d)), "basic")


def composite():
    return tx.composite(F.col("name_norm"), F.col("addr_norm"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("s1", "cid", F.round("score", 6).alias("score"))


def _weights(s, d):
    docs = rows(s, d).select("country", "doc", "side", vz.word_terms(composite()).alias("_t"))
    counts = vz.term_counts(docs, F.col("_t"))
    return vz.weights(counts, vz.vocabulary(counts, docs, WORD), WORD).select("doc", "term", F.round("w", 6).alias("w"))


add("blk1_word_tfidf", _weights, f"WITH {REC}, {BASIC}, {weights_sql(words_sql(COMPOSITE), WORD)} SELECT doc, term, round(w, 6) AS w FROM w")
add(
    "blk2_char_tfidf",
    lambda s, d: rounded(blocking.term_channel(rows(s, d), F.col("name_norm"), CHAR, 10, terms=partial(vz.char_terms, low=2, high=5))),
    channel_sql(chars_sql("name_norm", 2, 5), CHAR, 10),
)
add("blk3_cosine_product", lambda s, d: rounded(blocking.term_channel(rows(s, d), composite(), WORD, 30)), channel_sql(words_sql(COMPOSITE), WORD, 30))
add("blk4_address_jaccard", lambda s, d: rounded(blocking.term_channel(rows(s, d), F.col("addr_norm"), SET, 30)), channel_sql(words_sql("addr_norm"), SET, 30))
add(
    "blk4_address_jaccard_documents",
    lambda s, d: rounded(blocking.term_channel(write_table(entities(s, d).select(F.col("id").alias("doc"), F.col("src").alias("side"), "country", F.col("address").alias("addr_norm")), "entities"), F.col("addr_norm"), SET, 10)),
    "WITH e AS (SELECT doc_id AS doc, CASE WHEN doc_id % 10 < 3 THEN 'S1' WHEN doc_id % 10 < 7 THEN 'S2' ELSE 'S3' END AS side, coalesce(lang, '') AS country, "
    "string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g')), '\\s+') AS ws FROM documents), "
    f"n AS (SELECT doc, side, country, array_to_string(ws[7:18], ' ') AS addr_norm FROM e), {weights_sql(words_sql('addr_norm'), SET)}, {JACCARD} SELECT s1, cid, round(score, 6) AS score FROM ({top_sql(10)}) t",
)
NAMES = vz.Vectorizer(2, 0.05, 60_000, 1000)
add("blk5_sorted_names", lambda s, d: rounded(blocking.term_channel(rows(s, d), tx.sorted_tokens(F.col("name_norm")), NAMES, 25)), channel_sql(words_sql("name_norm"), NAMES, 25))


def _topk(s, d):
    docs = rows(s, d).select("country", "doc", "side", composite().alias("_x"))
    return sparse.best_products(docs, vz.word_terms, WORD, 5).select("s1", "cid", "rank")


add("blk6_top_k", _topk, f"WITH {REC}, {BASIC}, {weights_sql(words_sql(COMPOSITE), WORD)}, {PRODUCT} SELECT s1, cid, rank FROM ({top_sql(5)}) t")

# -- inverted indexes ------------------------------------------------------------------------------
_N, _C, _A = tx.universal(3), tx.clean_name(3), tx.universal(3)
V3 = (
    f"m AS (SELECT entity_id AS doc, src AS side, country, {_N.sql('name')} AS x, {_C.sql('name')} AS clean, address FROM records), "
    "r AS (SELECT doc, side, country, regexp_replace(x, '[^a-z0-9]', '', 'g') AS sp, list_distinct(list_filter(string_split_regex(x, '\\s+'), lambda t: length(t) > 1)) AS nw, substring(clean, 1, 3) AS f3, "
    "CASE WHEN regexp_extract(address, '\\b([1-9][0-9]{5})\\b', 1) <> '' THEN regexp_extract(address, '\\b([1-9][0-9]{5})\\b', 1) ELSE regexp_extract(address, '\\b([0-9]{5})\\b', 1) END AS pc, "
    "list_distinct(list_filter(list_transform(list_transform(list_slice(list_filter(string_split_regex(x, '\\s+'), lambda t: length(t) > 1), 1, 3), lambda w: regexp_replace(w, '[aeiouhw]', '', 'g')), "
    "lambda w: array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> string_split(w, '')[i - 1]), '')), lambda k: k <> '')) AS pk FROM m)"
)


def index_sql(key: str, most: int, score: str, where: str = "TRUE", at: str = "r") -> str:
    return (
        f"k AS (SELECT country, {key} AS key FROM {at} WHERE side <> 'S1' AND {key} <> '' GROUP BY ALL HAVING count(*) <= {most}) "
        f"SELECT DISTINCT a.doc AS s1, b.doc AS cid, {score} AS score FROM {at} a JOIN {at} b ON a.country = b.country AND a.{key} = b.{key} JOIN k ON k.country = a.country AND k.key = a.{key} "
        f"WHERE a.side = 'S1' AND b.side <> 'S1' AND {where}"
    )


def v3(s, d):
    return write_table(normalize.normalized(records(s, d)), "normal")


_OVER = "len(list_intersect(a.nw, b.nw)) > 0"
_WITH = f"WITH {REC}, {V3}, "
add("blk7_spaceless_index", lambda s, d: blocking.spaceless_channel(v3(s, d)), _WITH + index_sql("sp", 200, "0.85::DOUBLE", "length(a.sp) >= 4"))
add("blk8_postal_index", lambda s, d: blocking.postal_channel(v3(s, d)), _WITH + index_sql("pc", 2000, "0.40::DOUBLE", _OVER))
add("blk9_phonetic_index", lambda s, d: blocking.phonetic_channel(v3(s, d)), _WITH + "e AS (SELECT doc, side, country, nw, unnest(pk) AS one FROM r), " + index_sql("one", 500, "0.85::DOUBLE", _OVER, "e"))
_J = "len(list_intersect(a.nw, b.nw)) / len(list_distinct(list_concat(a.nw, b.nw)))"
add("blk10_first3_index", lambda s, d: rounded(blocking.prefix_channel(v3(s, d))), _WITH + index_sql("f3", 300, f"round({_J}, 6)", _OVER))
add(
    "blk11_premise_index",
    lambda s, d: blocking.premise_channel(write_table(pipeline.normal_records(records(s, d), config.RULES), "rules")).select("s1", "cid"),
    f"WITH {REC}, {rule_sql()}, r AS (SELECT doc, side, country, CASE WHEN length(city) >= 3 AND hn <> '' THEN city || '|' || hn ELSE '' END AS premise FROM ruled), "
    + f"p AS (WITH {index_sql('premise', 10, '0')}) SELECT s1, cid FROM p",
)
_HN = "lower(regexp_extract(address, '\\b([0-9]+[-/]?[0-9]*[a-zA-Z]?)\\b', 1))"


def _house(s, d):
    own = records(s, d).select(F.col("entity_id").alias("doc"), F.col("src").alias("side"), "country", ad.house_number_any(F.col("address")).alias("hn"))
    return blocking.key_channel(own, F.col("hn")).select("s1", "cid")


add(
    "blk12_house_index",
    _house,
    f"WITH {REC}, r AS (SELECT entity_id AS doc, src AS side, country, {_HN} AS hn FROM records) "
    "SELECT DISTINCT a.doc AS s1, b.doc AS cid FROM r a JOIN r b ON a.country = b.country AND a.hn = b.hn WHERE a.side = 'S1' AND b.side <> 'S1' AND a.hn <> ''",
)


def _union(s, d):
    own = v3(s, d)
    pairs = pipeline.candidates(own, config.V3)
    return pairs.select("s1", "cid", *(F.round(f"s_{c}", 6).alias(f"s_{c}") for c in blocking.CHANNELS), "channels_hit", "rank")


add("blk13_ordered_union", _union)


def _index_union(s, d):
    own = v3(s, d)
    made = {"spaceless": blocking.spaceless_channel(own), "postal": blocking.postal_channel(own)}
    return blocking.ordered_union(made, 20).select("s1", "cid", "s_word", "s_addr", "s_five", "rank")


add(
    "blk13_index_union",
    _index_union,
    _WITH
    + "a1 AS ("
    + "WITH " + index_sql("sp", 200, "0.85::DOUBLE", "length(a.sp) >= 4")
    + "), a2 AS ("
    + "WITH " + index_sql("pc", 2000, "0.40::DOUBLE", _OVER)
    + "), u AS (SELECT coalesce(a1.s1, a2.s1) AS s1, coalesce(a1.cid, a2.cid) AS cid, CASE WHEN a1.s1 IS NOT NULL THEN 0.85 ELSE 0.40 END::DOUBLE AS s_word, "
    "CASE WHEN a1.s1 IS NOT NULL THEN 0.0 ELSE 0.30 END::DOUBLE AS s_addr, CASE WHEN a1.s1 IS NOT NULL THEN 0.85 ELSE 0.40 END::DOUBLE AS s_five FROM a1 FULL JOIN a2 ON a1.s1 = a2.s1 AND a1.cid = a2.cid) "
    "SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY s_word DESC, cid) AS rank FROM u QUALIFY rank <= 20",
)


def two_channels(s, d) -> DataFrame:
    own = rows(s, d)
    made = {"word": blocking.term_channel(own, composite(), WORD, 30), "addr": blocking.term_channel(own, F.col("addr_norm"), SET, 30)}
    return blocking.simple_union(made, 50)


def matrix_sql(prefix: str, terms: str, v: vz.Vectorizer, k: int) -> str:
    body = f"WITH {weights_sql(terms, v)}, {JACCARD if v.binary else PRODUCT} SELECT s1, cid, score FROM ({top_sql(k)}) t"
    return f"{prefix} AS ({body})"


UNION_SQL = (
    f"WITH {REC}, {BASIC}, {matrix_sql('ca', words_sql(COMPOSITE), WORD, 30)}, {matrix_sql('cb', words_sql('addr_norm'), SET, 30)}, "
    "u AS (SELECT coalesce(ca.s1, cb.s1) AS s1, coalesce(ca.cid, cb.cid) AS cid, greatest(coalesce(ca.score, 0.0), coalesce(cb.score, 0.0)) AS score FROM ca FULL JOIN cb ON ca.s1 = cb.s1 AND ca.cid = cb.cid), "
    "cand AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cid) AS rank FROM u QUALIFY rank <= 50)"
)
add("blk14_two_channel_union", lambda s, d: two_channels(s, d).select("s1", "cid", F.round("score", 6).alias("score"), "rank"), UNION_SQL + " SELECT s1, cid, round(score, 6) AS score, rank FROM cand")


def vectors(s, d) -> tuple[DataFrame, DataFrame]:
    rows_ = table(s, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    q = rows_.where("vec_id % 10 = 0").select(F.col("vec_id").alias("s1"), F.col("embedding").alias("v"))
    return q, rows_.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v"))


_DOT = "list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) / sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_dot_product(c.v::DOUBLE[], c.v::DOUBLE[]))"
add(
    "blk15_exact_neighbours",
    lambda s, d: knn.exact(*vectors(s, d), 10).select("s1", "cid", F.round("score", 6).alias("score"), "rank"),
    f"WITH {EMBEDDED}, p AS (SELECT s1, cid, {_DOT} AS score FROM q, c) SELECT s1, cid, round(score, 6) AS score, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cid) AS rank FROM p QUALIFY rank <= 10",
)


def _listed(s, d):
    q, rest = vectors(s, d)
    every = rest.unionByName(q.select(F.col("s1").alias("cid"), "v"))
    return knn.inverted_lists(q, every, 10, 32, 24).select("s1", "cid", F.round("score", 6).alias("score"), "rank")


add("blk15_inverted_lists", _listed)


def _merged(s, d):
    text = two_channels(s, d).where("rank <= 5")
    own = rows(s, d)
    prefix = own.withColumn("first3", F.substring("name_norm", 1, 3)).withColumn("name_words", tx.word_set(F.col("name_norm")))
    near = vz.top_k(blocking.prefix_channel(prefix, 10_000), 4)
    return blocking.with_neighbours(text, near, 7).select("s1", "cid", "ann", "rank")


add(
    "blk16_merge_neighbours",
    _merged,
    UNION_SQL
    + ", t5 AS (SELECT s1, cid, rank FROM cand WHERE rank <= 5), g AS (SELECT doc, side, country, substring(name_norm, 1, 3) AS f3, list_distinct(list_filter(string_split_regex(name_norm, '\\s+'), lambda t: length(t) > 1)) AS nw FROM n), "
    f"e AS (SELECT a.doc AS s1, b.doc AS cid, {_J} AS score FROM g a JOIN g b ON a.country = b.country AND a.f3 = b.f3 WHERE a.side = 'S1' AND b.side <> 'S1' AND a.f3 <> '' AND {_OVER}), "
    "f AS (SELECT s1, cid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 9) DESC, cid) AS rank FROM e QUALIFY rank <= 4), "
    "b AS (SELECT s1, cid, 0 AS ann, rank AS r FROM t5 UNION ALL SELECT s1, cid, 1, rank FROM f WHERE NOT EXISTS (SELECT 1 FROM t5 WHERE t5.s1 = f.s1 AND t5.cid = f.cid)) "
    "SELECT s1, cid, ann, row_number() OVER (PARTITION BY s1 ORDER BY ann, r, cid) AS rank FROM b QUALIFY rank <= 7",
)
add("blk17_hashed_embedding", lambda s, d: records(s, d).select("id", joined(F.transform(knn.hashed_embedding(F.col("name"), 16), lambda x: F.format_string("%.4f", x))).alias("v")))


def _fallback(s, d):
    own = records(s, d).where("NOT (src <> 'S1' AND country = 'France')").select(F.col("entity_id").alias("doc"), F.col("src").alias("side"), "country")
    return blocking.with_country_fallback(own).groupBy("country", "side").agg(F.count(F.lit(1)).alias("n"))


add(
    "blk18_country_fallback",
    _fallback,
    f"WITH {REC}, r AS (SELECT src AS side, country FROM records WHERE NOT (src <> 'S1' AND country = 'France')), b AS (SELECT DISTINCT country FROM r WHERE side = 'S1' AND country NOT IN (SELECT country FROM r WHERE side <> 'S1')) "
    "SELECT country, side, count(*) AS n FROM (SELECT * FROM r UNION ALL SELECT r.side, b.country FROM r, b WHERE r.side <> 'S1') u GROUP BY ALL",
)

# -- features --------------------------------------------------------------------------------------
def _dense(preset):
    def run(s, d):
        own = write_table(pipeline.normal_records(records(s, d), preset), "normal")
        pairs = pipeline.candidate_table(own, preset)
        made = pipeline.feature_rows(pairs, own, preset)
        return made.select("s1", "cid", *(F.round(n, 6).alias(n) for n in preset.features))

    return run


for _preset in (config.THREE_CHANNEL, config.LGBM_V1, config.V1, config.V2, config.V3, config.V4, config.RESCORE):
    add(f"features_{len(_preset.features)}_{_preset.name}", _dense(_preset))


def _set_features(s, d):
    own = rows(s, d)
    both = ft.paired(two_channels(s, d), own)
    w1, w2 = tx.word_set(F.col("a_name_norm")), tx.word_set(F.col("b_name_norm"))
    a1, a2 = tx.word_set(F.col("a_addr_norm")), tx.word_set(F.col("b_addr_norm"))
    return both.select(
        "s1", "cid", F.round(sm.jaccard(w1, w2), 6).alias("name_jaccard"), F.round(sm.containment(w1, w2), 6).alias("name_containment"),
        F.round(sm.jaccard(a1, a2), 6).alias("addr_jaccard"), F.round(sm.length_ratio(F.col("a_name_norm"), F.col("b_name_norm")), 6).alias("len_ratio"),
        sm.flag((F.col("a_addr_norm") == "") != (F.col("b_addr_norm") == "")).alias("one_missing"),
    )


def _jac(a: str, b: str) -> str:
    return f"round(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END, 6)"


_LONG = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda t: length(t) > 1))"
add(
    "features_sets",
    _set_features,
    UNION_SQL
    + f", k AS (SELECT doc, name_norm, addr_norm, {_LONG.format('name_norm')} AS nw, {_LONG.format('addr_norm')} AS aw FROM n) "
    f"SELECT s1, cid, {_jac('a.nw', 'b.nw')} AS name_jaccard, round(CASE WHEN least(len(a.nw), len(b.nw)) > 0 THEN len(list_intersect(a.nw, b.nw)) / least(len(a.nw), len(b.nw)) ELSE 0.0 END, 6) AS name_containment, "
    f"{_jac('a.aw', 'b.aw')} AS addr_jaccard, round(CASE WHEN greatest(length(a.name_norm), length(b.name_norm)) > 0 THEN least(length(a.name_norm), length(b.name_norm)) / greatest(length(a.name_norm), length(b.name_norm)) ELSE 0.0 END, 6) AS len_ratio, "
    "((a.addr_norm = '') <> (b.addr_norm = ''))::INT::DOUBLE AS one_missing FROM cand JOIN k a ON a.doc = s1 JOIN k b ON b.doc = cid",
)
FEATURE_LISTS = (fixed.FEATURES_16, fixed.FEATURES_18, fixed.FEATURES_32, fixed.FEATURES_35, fixed.FEATURES_50, fixed.FEATURES_51, fixed.FEATURES_RESCORE)
