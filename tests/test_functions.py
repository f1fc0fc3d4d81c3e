import random

import pytest
from pyspark.sql import functions as F

from kinlink.functions import address as ad
from kinlink.functions import similarity as sm
from kinlink.functions import text as tx


def values(spark, make, inputs):
    """The values of make(x) for inputs x."""
    column = make(F.col("x"))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_basic_normal_form(spark):
    got = values(spark, tx.BASIC.col, ["-- Acme  Motors, Inc.", "prime.com", None, "nan", "<<Café_9!", "राम ट्रेडिंग"])
    assert got == ["acme motors inc", "prime", "", "", "café_9", "र म ट र ड ग"]


def test_universal_forms(spark):
    names = ["Apex 0042 LLC", "Société Générale SARL", "M/s. Prime-Money.co.in Pvt Ltd", "null", "5 bd Voltaire", "00"]
    assert values(spark, tx.universal(3).col, names) == [
        "apex 42 limited liability", "societe generale sarl", "prime money private limited", "", "5 boulevard voltaire", "0",
    ]
    assert values(spark, tx.clean_name(3).col, names)[:3] == ["apex 42", "generale", "prime money"]
    assert values(spark, tx.universal(1).col, ["राम"]) == ["raam"]
    assert values(spark, tx.universal(3).col, ["राम १२"]) == ["raam 12"]


def test_prefix_quirk_in_both_modes(spark):
    names = ["Akash Traders", "Drake Inc", "-- dba foo"]
    assert values(spark, tx.universal(3).col, names) == ["akash traders", "drake incorporated", "foo"]
    assert values(spark, tx.universal(3, strict=True).col, names) == ["sh traders", "ake incorporated", "dba foo"]


def test_other_names(spark):
    assert values(spark, tx.DEEP.col, ["Trading as: Blue Sky Holdings LLC"]) == ["blue sky"]
    assert values(spark, tx.leet().col, ["g0ld 1n m3tal b4nk"]) == ["gold 1n metal bank"]
    assert values(spark, tx.RESCORE_NAME.col, ["Acme-Motors  Corp."]) == ["acme motors"]
    assert values(spark, lambda x: tx.script(x), ["abc", "राम a", "", "123", "తెలుగు", "日本"]) == ["latin", "devanagari", "empty", "empty", "telugu", "latin"]
    assert values(spark, lambda x: tx.legal_suffix(x), ["Foo Pvt Ltd", "Foo", "Inc. Corp"]) == ["private limited", "", "incorporated"]
    assert values(spark, lambda x: tx.phonetic_keys(tx.universal(3).col(x)), ["Motors Apex Foo"]) == [["f", "mtrs", "px"]]


def test_sets_and_grams(spark):
    assert values(spark, lambda x: tx.char_ngrams(x, 3, joined=True), ["ab cd", "ab", ""]) == [["_cd", "ab_", "b_c"], ["ab"], []]
    assert values(spark, lambda x: tx.char_ngrams(x, 2), ["aaa", "a"]) == [["aa"], []]
    assert values(spark, lambda x: tx.word_set(x), ["b a bb aa bb", ""]) == [["aa", "bb"], []]
    assert values(spark, lambda x: tx.numeric_tokens(x), ["007 x9 00 a"]) == [["7", "x9"]]


def test_addresses(spark):
    lines = ["12 Main St, Dallas, Texas 75201", "Plot No 45/A, MG Road, Hyderabad, Telangana 500001", "12 North Street", "Noida Sector 5", "", None, "00201 Oak Ave, Reno, NV"]
    assert values(spark, lambda x: ad.house_number(x), lines) == ["12", "45/a", "12", "5", "", "", "201"]
    assert values(spark, lambda x: ad.house_number(x, strict=True), lines)[2:4] == ["rth", "ida"]
    assert values(spark, lambda x: ad.postal_code(x), lines) == ["75201", "500001", "", "", "", "", "00201"]
    assert values(spark, lambda x: ad.house_number_whole(x), ["007b Oak", "at 45 marg x", "000 x", "x"]) == ["7", "45", "0", ""]
    assert values(spark, lambda x: ad.city(x), lines) == ["dallas", "hyderabad", "", "", "", "", "reno"]
    assert values(spark, lambda x: ad.state(x, F.lit("US")), ["x, West Virginia", "x, WV", "a in or", "x"]) == ["wv", "wv", "in", ""]
    assert values(spark, lambda x: ad.state(x, F.lit("US"), strict=True), ["x, West Virginia"]) == ["va"]
    assert values(spark, lambda x: ad.postal_code_by_country(x, F.lit("India"), F.lit("")), ["500001 and 500002", "75201"]) == ["500002", ""]
    assert values(spark, lambda x: ad.postal_code_five_first(x), ["75201-1234", "500001"]) == ["75201", "500001"]


@pytest.mark.parametrize("seed", range(3))
def test_kernels_against_plain_tables(seed):
    r = random.Random(seed)

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert sm.lcs_length(a, b) == lcs(a, b)
        if a and b:
            short, long = sorted((a, b), key=len)
            m = len(short)
            best = max(sm.ratio(short, long[max(s, 0) : s + m]) for s in range(1 - m, len(long)))
            assert sm.partial_ratio(a, b) >= best - 1e-12


def test_kernels():
    assert sm.token_sort_ratio("motors apex", "apex motors") == 1
    assert sm.token_set_ratio("apex motors", "apex motors ltd") == 1
    assert sm.token_set_ratio("", "a") == 0
    assert sm.ratio("", "") == 1
    assert round(sm.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert sm.partial_ratio("abc", "xxabcxx") == 1


def test_column_similarities(spark):
    df = spark.createDataFrame([("a b", "b c", [1.0, 0.0], [1.0, 1.0]), ("", "x", None, [1.0])], "a string, b string, v array<double>, w array<double>")
    row = df.select(sm.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))).alias("j"), sm.cosine(F.col("v"), F.col("w")).alias("c"), sm.string_similarities(F.col("a"), F.col("b")).alias("s")).collect()
    assert abs(row[0].j - 1 / 3) < 1e-12 and abs(row[0].c - 0.5**0.5) < 1e-12
    assert row[1].j == 0 and row[1].c == 0 and row[1].s.ratio == 0
