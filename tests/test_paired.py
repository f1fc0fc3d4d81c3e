import random

import numpy as np
from pyspark.sql import functions as F

from kinlink.functions import similarity as sm
from kinlink.operators import features, model
from kinlink.plans import config, pipeline
from kinlink.sources.records import records, truth

ROWS = [
    ("a", "S1", "X", ["u", "v"]), ("a", "S1", "Y", ["v"]), ("b", "S1", "X", []), (None, "S1", "X", ["u"]), ("e", None, "X", ["u"]),
    ("c", "S2", "X", ["v", "u", "w"]), ("d", "S3", "X", None), ("d", "S2", "Z", ["w"]), ("a", "S3", "X", ["u"]),
]
PAIRS = [("a", "c", 1), ("a", "d", 2), ("b", "d", 3), ("a", "a", 4), ("b", "x", 5), ("x", "c", 6), (None, "c", 7), ("a", None, 8), ("a", "c", 9), ("c", "b", 10), ("e", "c", 11)]


def test_paired_against_loops(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, "doc string, side string, country string, words array<string>")
    pairs = spark.createDataFrame(PAIRS, "s1 string, cid string, n int")
    want = sorted(
        (n, c1, c2, None if w1 is None or w2 is None else len(set(w1) & set(w2)))
        for s1, cid, n in PAIRS for d1, x, c1, w1 in ROWS for d2, y, c2, w2 in ROWS
        if s1 is not None and d1 == s1 and x == "S1" and d2 == cid and y in ("S2", "S3")
    )
    for size in (1, 100):
        monkeypatch.setattr(features, "QUERIES", size)
        monkeypatch.setattr(features, "CORPUS", size)
        for sets in ((), ("words",)):
            both = features.paired(pairs, rows, sets)
            got = both.select("n", "a_country", "b_country", F.when(F.col("a_words").isNotNull() & F.col("b_words").isNotNull(), F.size(F.array_intersect("a_words", "b_words")))).collect()
            assert sorted(tuple(r) for r in got) == want
    assert features.paired(pairs.limit(0), rows).count() == 0 and features.paired(pairs, rows.limit(0)).count() == 0


def test_records_are_not_dealt_with_every_pair(spark, sf):
    own = pipeline.normal_records(records(spark, sf), config.V2)
    pairs = spark.createDataFrame([("S1-000000010", "S2-000000013")], "s1 string, cid string").withColumn("rank", F.lit(1))
    pairs = pairs.selectExpr("*", *(f"0.5D AS s_{c}" for c in ("word", "addr", "char", "sorted")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = pipeline.feature_rows(pairs, own, config.V2)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [(r.s1, r.cid, r.country) for r in made.collect()] == [("S1-000000010", "S2-000000013", "India")]


def test_labels_come_with_the_pairs(spark, sf):
    own = records(spark, sf)
    rows = pipeline.normal_records(own, config.THREE_CHANNEL)
    made = pipeline.feature_rows(model.label(pipeline.candidates(rows, config.THREE_CHANNEL), truth(own)), rows, config.THREE_CHANNEL)
    known = {(r.s1, r.cid) for r in truth(own).collect()}
    got = made.select("s1", "cid", "label").collect()
    assert got and all((r.label == 1) == ((r.s1, r.cid) in known) for r in got)


def test_jaro_winkler_of_all_pairs_of_a_batch():
    draw = random.Random(3)
    words = ["", "a", "ab ab", "é\0x", "b" * 64, "ab" * 40]
    words += ["".join(draw.choice("abcé ") for _ in range(draw.randint(1, 66))) for _ in range(60)]
    x, y = zip(*((a, b) for a in words for b in words), strict=True)
    assert sm.KERNELS["jaro_winkler"] is sm._jaro_winklers
    assert np.array_equal(sm._jaro_winklers(list(x), list(y)), [sm.jaro_winkler(a, b) for a, b in zip(x, y, strict=True)])
