"""Queries of text and address functions over the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address as ad
from ..functions import fixed
from ..functions import similarity as sm
from ..functions import text as tx
from .base import REC, add, joined, on_records, quote, records

N3 = tx.universal(3)


def chains(query: str, **rules: tuple[tx.Chain, str]) -> None:
    on_records(query, lambda: {k: c.col(x) for k, (c, x) in rules.items()}, {k: c.sql(x) for k, (c, x) in rules.items()})


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def set_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '|')"


def long_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: length(t) > 1)"


def grams_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_transform(generate_series(1, length({x}) - {n - 1}), lambda i: substring({x}, i, {n})) ELSE [] END"


chains("str1_normalize_text", name=(tx.BASIC, "name"), address=(tx.BASIC, "address"))
chains("str2_normalize_name_suffixes", name=(tx.NAME_SUFFIXES, "name"))
chains("str3_normalize_address", address=(tx.ADDRESS, "address"))
chains("str4_universal_v1", name=(tx.universal(1), "name"), strict=(tx.universal(1, True), "name"), address=(tx.universal(1), "address"))
chains("str5_universal_v3", name=(tx.universal(3), "name"), v2=(tx.universal(2), "name"), strict=(tx.universal(3, True), "name"), address=(tx.universal(3), "address"))
chains("str6_clean_name", v1=(tx.clean_name(1), "name"), v3=(tx.clean_name(3), "name"))
chains("str7_deep_name", name=(tx.DEEP, "name"))
chains("str8_rule_name", name=(tx.RULE_NAME, "name"), leet=(tx.LOWER + tx.sub("o", "0") + tx.leet(), "name"))
chains("str9_rescore_name", name=(tx.RESCORE_NAME, "name"))
_N = N3.sql("name")
on_records("str10_spaceless", lambda: {"key": tx.spaceless(N3.col("name"))}, {"key": f"regexp_replace({_N}, '[^a-z0-9]', '', 'g')"})
chains("str11_indic_letters", v1=(tx.INDIC, "name"), v3=(tx.SCRIPT, "name"))
chains("str12_accents", name=(tx.ASCII, "name"))
_SCRIPTS = ", ".join(f"length(l) - length(regexp_replace(l, '\\p{{{n}}}', '', 'g')) AS {k}" for k, n in tx.SCRIPTS)
_KEYS = ", ".join(k for k, _ in tx.SCRIPTS)
add(
    "str13_script",
    lambda s, d: records(s, d).select("id", tx.script(F.col("name")).alias("script")),
    f"WITH {REC}, a AS (SELECT id, regexp_replace(name, '[^\\p{{L}}]', '', 'g') AS l FROM records), b AS (SELECT id, l, {_SCRIPTS} FROM a), "
    f"c AS (SELECT *, length(l) - ({' + '.join(k for k, _ in tx.SCRIPTS)}) AS latin FROM b) "
    f"SELECT id, CASE WHEN l = '' THEN 'empty' WHEN latin = greatest(latin, {_KEYS}) THEN 'latin' "
    + " ".join(f"WHEN {k} = greatest(latin, {_KEYS}) THEN '{k}'" for k, _ in tx.SCRIPTS)
    + " END AS script FROM c",
)
on_records("str14_composite", lambda: {"text": tx.composite(tx.BASIC.col("name"), tx.BASIC.col("address"))}, {"text": f"trim({tx.BASIC.sql('name')} || ' ' || {tx.BASIC.sql('name')} || ' ' || {tx.BASIC.sql('address')})"})
on_records("str15_sorted_tokens", lambda: {"text": tx.sorted_tokens(tx.BASIC.col("name"))}, {"text": f"array_to_string(list_sort({words_sql(tx.BASIC.sql('name'))}), ' ')"})
on_records(
    "str16_word_set",
    lambda: {"words": joined(tx.word_set(tx.BASIC.col("name"))), "first": tx.first_word(tx.BASIC.col("name"))},
    {"words": set_sql(long_sql(tx.BASIC.sql("name"))), "first": f"coalesce({words_sql(tx.BASIC.sql('name'))}[1], '')"},
)
add(
    "str17_char_ngrams",
    lambda s, d: records(s, d).select("id", N3.col("name").alias("x")).select("id", joined(tx.char_ngrams(F.col("x"), 2)).alias("bigrams"), joined(tx.char_ngrams(F.col("x"), 3, joined=True)).alias("trigrams")),
    f"WITH {REC}, a AS (SELECT id, {_N} AS x, replace({_N}, ' ', '_') AS y FROM records) SELECT id, {set_sql(grams_sql('x', 2))} AS bigrams, "
    f"CASE WHEN length(y) >= 3 THEN {set_sql(grams_sql('y', 3))} ELSE y END AS trigrams FROM a",
)
add(
    "str18_phonetic_keys",
    lambda s, d: records(s, d).select("id", joined(tx.phonetic_keys(N3.col("name"))).alias("keys")),
    f"WITH {REC}, a AS (SELECT id, list_transform(list_slice({long_sql(_N)}, 1, 3), lambda w: regexp_replace(w, '[aeiouhw]', '', 'g')) AS l FROM records), "
    "b AS (SELECT id, list_filter(list_transform(l, lambda w: array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> string_split(w, '')[i - 1]), '')), lambda k: k <> '') AS k FROM a) "
    f"SELECT id, {set_sql('k')} AS keys FROM b",
)
add(
    "str19_numeric_tokens",
    lambda s, d: records(s, d).select("id", joined(tx.numeric_tokens(N3.col("address"))).alias("nums")),
    f"WITH {REC}, a AS (SELECT id, {N3.sql('address')} AS x FROM records) SELECT id, "
    + set_sql(f"list_filter(list_transform(list_filter({words_sql('x')}, lambda t: regexp_matches(t, '[0-9]')), lambda t: regexp_replace(t, '^0+', '')), lambda t: t <> '')")
    + " AS nums FROM a",
)
on_records("str20_prefix_keys", lambda: {f"p{n}": tx.prefix_key(tx.BASIC.col("name"), n) for n in (3, 4, 5)}, {f"p{n}": f"substring({tx.BASIC.sql('name')}, 1, {n})" for n in (3, 4, 5)})
on_records(
    "str21_legal_suffix",
    lambda: {"suffix": tx.legal_suffix(F.col("name"))},
    {"suffix": "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {quote(p)}) THEN {quote(t)}" for p, t in fixed.LEGAL_REWRITES_V3) + " ELSE '' END"},
)
on_records("str22_script_flags", lambda: {"indic": tx.has_indic(F.col("name")), "other": tx.has_non_ascii(F.col("name"))}, {"indic": "regexp_matches(name, '[ऀ-ൿ]')", "other": "regexp_matches(name, '[^\\x00-\\x7F]')"})

# -- addresses ---------------------------------------------------------------------------------
_W = fixed.NUMBER_WORDS


def _after(gap: str) -> str:
    return f"regexp_extract(lower(address), '\\b(?:{_W}){gap}([a-z0-9/\\-]+)', 1)"


_FIRST = "regexp_extract(lower(address), '\\b([0-9][a-z0-9_/\\-]*)\\b', 1)"
_LOOSE = _after(r"(?:\s+|[:#]\s*|\.\s*|\b)")
_STRICT = _after(r"\s*")
on_records(
    "adr1_house_number",
    lambda: {"hn": ad.house_number(F.col("address")), "strict": ad.house_number(F.col("address"), True)},
    {
        "hn": f"regexp_replace(CASE WHEN regexp_matches({_LOOSE}, '[0-9]') THEN {_LOOSE} ELSE {_FIRST} END, '^0+', '')",
        "strict": f"regexp_replace(CASE WHEN {_STRICT} <> '' THEN {_STRICT} ELSE {_FIRST} END, '^0+', '')",
    },
)
on_records("adr2_house_number_leading", lambda: {"hn": ad.house_number_leading(F.col("address"))}, {"hn": "regexp_extract(trim(address), '^([0-9]+[-/]?[0-9]*)\\s', 1)"})
_LEAD = "regexp_extract(trim(address), '^\\s*([0-9]+[a-zA-Z]?)[\\s,/-]', 1)"
_STREET = f"regexp_extract(trim(address), '(?i)\\b([0-9]+)\\s+(?:{fixed.HOUSE_STREETS})\\b', 1)"
WHOLE_SQL = (
    f"(CASE WHEN regexp_extract(CASE WHEN {_LEAD} <> '' THEN {_LEAD} ELSE {_STREET} END, '^([0-9]+)', 1) = '' THEN '' "
    f"ELSE CAST(CAST(regexp_extract(CASE WHEN {_LEAD} <> '' THEN {_LEAD} ELSE {_STREET} END, '^([0-9]+)', 1) AS BIGINT) AS VARCHAR) END)"
)
on_records("adr3_house_number_whole", lambda: {"hn": ad.house_number_whole(F.col("address"))}, {"hn": WHOLE_SQL})
RULE_TEXT = tx.MISSING + tx.LOWER + tx.TRIM + tx.INDIC + tx.ASCII


def rule_sql() -> str:
    """The CTE ``ruled``: records with hn, city, state and the text that the rule engine takes tokens and numbers from."""
    states = []
    for which, names in (("US", fixed.US_STATES), ("India", fixed.INDIA_STATES)):
        tests = " ".join(f"WHEN regexp_matches(x, '\\b{n}\\b|\\b{c}\\b') THEN '{c}'" for n, c in names.items())
        states.append(f"WHEN '{which}' THEN (CASE {tests} ELSE '' END)")
    one, two, three = (
        f"ltrim(regexp_extract(x, '{pattern}', 1), '0')"
        for pattern in (rf"\b(?:{_W})\s*([a-z0-9/\-]+)", r"\b([0-9]+[a-z0-9_/\-]+)", r"\b0*([0-9]+[a-z]?)\b")
    )
    return (
        f"w AS (SELECT id, entity_id, src, country, {RULE_TEXT.sql('address')} AS x FROM records), "
        "v AS (SELECT *, list_filter(list_transform(string_split(x, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM w), "
        f"ruled AS (SELECT id, entity_id AS doc, src AS side, country, CASE WHEN {one} <> '' THEN {one} WHEN {two} <> '' THEN {two} ELSE {three} END AS hn, "
        "trim(regexp_replace(coalesce(parts[-2], parts[1], ''), '[^a-zA-Z0-9_\\s]', '', 'g')) AS city, "
        f"CASE country {' '.join(states)} ELSE '' END AS state, {tx._rewrites(fixed.STREET_RULES).sql('x')} AS long FROM v)"
    )


_RULE_STOP = "[" + ", ".join(map(quote, fixed.ADDRESS_STOP_RULES)) + "]"
_RULE_WORDS = f"list_filter({long_sql(tx.NOT_WORD_ASCII.sql('long'))}, lambda w: NOT list_contains({_RULE_STOP}, w) AND w <> hn AND w <> state)"
_RULE_NUMS = "list_filter(list_transform(regexp_extract_all(long, '\\b0*([0-9]+)\\b', 1), lambda n: ltrim(n, '0')), lambda n: n <> '')"
add(
    "adr4_rule_address",
    lambda s, d: records(s, d)
    .select("id", "country", RULE_TEXT.col("address").alias("x"))
    .select("id", ad.rule_address(F.col("x"), F.col("country")).alias("a"))
    .select("id", "a.hn", joined(F.col("a.tokens")).alias("tokens"), "a.city", joined(F.col("a.nums")).alias("nums"), "a.state"),
    f"WITH {REC}, {rule_sql()} SELECT id, hn, {set_sql(_RULE_WORDS)} AS tokens, city, {set_sql(_RULE_NUMS)} AS nums, state FROM ruled",
)
on_records(
    "adr5_simple_extracts",
    lambda: {"any": ad.house_number_any(F.col("address")), "pc": ad.postal_code_any(F.col("address")), "lead": ad.house_number_digits(F.col("address")), "last": ad.postal_code_last(F.col("address"))},
    {
        "any": "lower(regexp_extract(address, '\\b([0-9]+[-/]?[0-9]*[a-zA-Z]?)\\b', 1))",
        "pc": "regexp_extract(address, '\\b([0-9]{5,6})\\b', 1)",
        "lead": "regexp_extract(trim(address), '^([0-9]+)', 1)",
        "last": "coalesce(regexp_extract_all(address, '\\b([0-9]{5,6})\\b', 1)[-1], '')",
    },
)
_SIX, _FIVE = "regexp_extract(address, '\\b([1-9][0-9]{5})\\b', 1)", "regexp_extract(address, '\\b([0-9]{5})\\b', 1)"
on_records("adr6_postal_code", lambda: {"pc": ad.postal_code(F.col("address"))}, {"pc": f"CASE WHEN {_SIX} <> '' THEN {_SIX} ELSE {_FIVE} END"})
_FOUR = "regexp_extract(address, '\\b([0-9]{5})(?:-[0-9]{4})?\\b', 1)"
on_records("adr7_postal_five_first", lambda: {"pc": ad.postal_code_five_first(F.col("address"))}, {"pc": f"CASE WHEN {_FOUR} <> '' THEN {_FOUR} ELSE regexp_extract(address, '\\b([0-9]{{6}})\\b', 1) END"})
COUNTRY_CODE = (
    "coalesce(CASE WHEN country = 'India' THEN regexp_extract_all(trim(address), '\\b([1-9][0-9]{5})\\b', 1) "
    "ELSE regexp_extract_all(trim(address), '\\b([0-9]{5})\\b', 1) END[-1], '')"
)
add(
    "adr8_postal_by_country",
    lambda s, d: records(s, d).select("id", ad.postal_code_by_country(F.col("address"), F.col("country"), ad.house_number_whole(F.col("address"))).alias("pc")),
    f"WITH {REC}, a AS (SELECT id, {WHOLE_SQL} AS hn, {COUNTRY_CODE} AS pc FROM records) SELECT id, CASE WHEN pc = hn THEN '' ELSE pc END AS pc FROM a",
)
_STOP = "[" + ", ".join(map(quote, fixed.ADDRESS_STOP_V3)) + "]"
add(
    "adr9_address_tokens",
    lambda s, d: records(s, d).select("id", joined(ad.address_tokens(N3.col("address"))).alias("tokens")),
    f"WITH {REC}, a AS (SELECT id, {N3.sql('address')} AS x FROM records) SELECT id, "
    + set_sql(f"list_filter({long_sql('x')}, lambda w: NOT list_contains({_STOP}, w))")
    + " AS tokens FROM a",
)
on_records(
    "adr10_city_state",
    lambda: {"city": ad.city(F.col("address")), "state": ad.state_part(F.col("address"))},
    {"city": "lower(trim(coalesce(string_split(address, ',')[-2], '')))", "state": "lower(trim(string_split(address, ',')[-1]))"},
)


def state_sql(names: dict[str, str], strict: bool) -> str:
    order = list(names.items()) if strict else sorted(names.items(), key=lambda x: (-len(x[0]), x[0]))
    tests = " ".join(f"WHEN {f'contains(lower(address), {quote(n)})' if strict else f'regexp_matches(lower(address), {quote(chr(92) + "b" + n + chr(92) + "b")})'} THEN '{c}'" for n, c in order)
    codes = "[" + ", ".join(map(quote, sorted(set(names.values())))) + "]"
    return f"CASE {tests} ELSE coalesce(list_min(list_filter(regexp_extract_all(lower(address), '\\b([a-z]{{2,}})\\b', 1), lambda w: list_contains({codes}, w))), '') END"


def state_of(strict: bool) -> str:
    return f"CASE country WHEN 'US' THEN {state_sql(fixed.US_STATES, strict)} WHEN 'India' THEN {state_sql(fixed.INDIA_STATES, strict)} ELSE '' END"


on_records("adr11_state", lambda: {"state": ad.state(F.col("address"), F.col("country")), "strict": ad.state(F.col("address"), F.col("country"), True)}, {"state": state_of(False), "strict": state_of(True)})

# -- similarities: each record with the next one -------------------------------------

def _pairs(s, d):
    rows = records(s, d).select("id", N3.col("name").alias("x"), tx.word_set(N3.col("name")).alias("w"), N3.col("address").alias("a"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"), F.col("w").alias("v"), F.col("a").alias("b"))
    return rows.join(after, "id")


_X = N3.sql("name")
_P = (
    f"WITH {REC}, r AS (SELECT id, {_X} AS x, list_sort(list_distinct({long_sql(_X)})) AS w, {N3.sql('address')} AS a FROM records), "
    "p AS (SELECT r.id, r.x, s.x AS y, r.w, s.w AS v, r.a, s.a AS b FROM r JOIN r s ON s.id = r.id + 1) "
)


def _kernel(name: str):
    return lambda s, d: _pairs(s, d).select("id", F.round(sm.string_similarities(F.col("x"), F.col("y"), (name,)).getField(name), 6).alias("score"))


add("sim1_ratio", _kernel("ratio"))
add("sim2_token_sort_ratio", _kernel("token_sort_ratio"))
add("sim3_token_set_ratio", _kernel("token_set_ratio"))
add("sim4_partial_ratio", _kernel("partial_ratio"))
add(
    "sim5_levenshtein",
    lambda s, d: _pairs(s, d).select("id", F.round(sm.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("score")),
    _P + "SELECT id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS score FROM p",
)
add("sim6_jaro_winkler", _kernel("jaro_winkler"), _P + "SELECT id, round(CASE WHEN x = '' OR y = '' THEN 0.0 ELSE jaro_winkler_similarity(x, y) END, 6) AS score FROM p")
add("sim7_sequence_ratio", _kernel("sequence_ratio"))
_I, _U = "len(list_intersect(w, v))", "len(list_distinct(list_concat(w, v)))"
add(
    "sim8_jaccard",
    lambda s, d: _pairs(s, d).select("id", F.round(sm.jaccard(F.col("w"), F.col("v")), 6).alias("score")),
    _P + f"SELECT id, round(CASE WHEN {_U} > 0 THEN {_I} / {_U} ELSE 0.0 END, 6) AS score FROM p",
)
add(
    "sim9_containment",
    lambda s, d: _pairs(s, d).select("id", F.round(sm.containment(F.col("w"), F.col("v")), 6).alias("score")),
    _P + f"SELECT id, round(CASE WHEN least(len(w), len(v)) > 0 THEN {_I} / least(len(w), len(v)) ELSE 0.0 END, 6) AS score FROM p",
)
add(
    "sim10_tri_state",
    lambda s, d: _pairs(s, d).select("id", sm.tri_state(F.col("x"), F.col("y")).alias("same"), sm.tri_state(F.col("x"), F.col("y"), inside=True).alias("inside")),
    _P + "SELECT id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE -1.0 END::DOUBLE AS same, "
    "CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y OR contains(x, y) OR contains(y, x) THEN 1.0 ELSE -1.0 END::DOUBLE AS inside FROM p",
)
add(
    "sim11_lengths_and_flags",
    lambda s, d: _pairs(s, d).select(
        "id",
        F.round(sm.length_ratio(F.col("x"), F.col("y")), 6).alias("len_ratio"),
        F.abs(F.size("w") - F.size("v")).cast("long").alias("word_diff"),
        sm.flag(tx.first_word(F.col("x")) == tx.first_word(F.col("y"))).alias("first"),
        sm.flag(tx.prefix_key(F.col("x"), 3) == tx.prefix_key(F.col("y"), 3)).alias("prefix"),
        sm.flag(F.col("x") == F.col("y")).alias("exact"),
    ),
    _P + f"SELECT id, round(CASE WHEN greatest(length(x), length(y)) > 0 THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE 0.0 END, 6) AS len_ratio, "
    f"abs(len(w) - len(v))::BIGINT AS word_diff, (coalesce({words_sql('x')}[1], '') = coalesce({words_sql('y')}[1], ''))::INT::DOUBLE AS first, "
    "(substring(x, 1, 3) = substring(y, 1, 3))::INT::DOUBLE AS prefix, (x = y)::INT::DOUBLE AS exact FROM p",
)
add(
    "sim12_cosine",
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").alias("a").join(s.read.parquet(f"{d}/embeddings.parquet").alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    .select(F.col("a.vec_id").alias("id"), F.round(sm.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score")),
    "SELECT a.vec_id AS id, round(coalesce(greatest(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * "
    "list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0.0), 0.0), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
add(
    "sim13_blend",
    lambda s, d: _pairs(s, d).select("id", F.round(sm.blend(name=(0.6, sm.jaccard(F.col("w"), F.col("v"))), text=(0.4, sm.levenshtein_similarity(F.col("x"), F.col("y")))), 6).alias("score")),
    _P + f"SELECT id, round(0.6::DOUBLE * (CASE WHEN {_U} > 0 THEN {_I} / {_U} ELSE 0.0 END) + 0.4::DOUBLE * (CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END), 6) AS score FROM p",
)
