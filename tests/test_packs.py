import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as sm
from kinlink.operators import blocking, features, packs, tables
from kinlink.plans import config, pipeline
from kinlink.sources.records import records

PAIR = "s1 string, cid string, score double"


def test_pairs_are_dealt_as_files(spark, monkeypatch):
    """A shuffle of pairs has a row for many of them."""
    seen = []
    monkeypatch.setattr(features, "pack", lambda *a: seen.append(a[:2]) or packs.pack(*a))
    rows = spark.createDataFrame([("a", "S1", "x"), ("b", "S2", "x")], "doc string, side string, country string")
    pairs = spark.createDataFrame([("a", "b", n, float(n), None) for n in range(50)], "s1 string, cid string, n int, score double, label double")
    got = features.paired(pairs, rows).select("n", "score", "label", "b_country").collect()
    assert seen == [("_left", "_block"), ("_qb", "_cb")]
    assert sorted(tuple(r) for r in got) == [(n, float(n), None, "x") for n in range(50)]


def test_files_hold_equal_values_once():
    rows = pa.RecordBatch.from_pydict({"a": pa.array([n % 3 for n in range(9000)], pa.int32()), "b": pa.array([0] * 9000, pa.int32()), "x": [f"S1-{n // 90:09d}" for n in range(9000)]})
    (out,) = packs.pack("a", "b", 10_000)(iter([rows]))
    assert out["a"].to_pylist() == [0, 1, 2] and sum(map(len, out["_blob"].to_pylist())) < 2 * rows.num_rows
    assert sorted(x for t in packs.opened(out["_blob"]) for x in t["x"].to_pylist()) == sorted(rows["x"].to_pylist())


def test_nine_digits_as_spark_rounds(spark):
    draw = random.Random(1)
    x = [n / 2e9 for n in range(3001)] + [draw.random() for _ in range(2000)] + [-0.1234567885, 12345.1234567895, 0.0, 1.0]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).alias("y")).collect()]
    assert (blocking._nine(np.array(x)) / 1e9).tolist() == want


@pytest.mark.parametrize("buckets", [1, 7])
def test_union_against_loops(spark, monkeypatch, buckets):
    monkeypatch.setattr(blocking, "BUCKETS", buckets)
    draw = random.Random(buckets)
    made = {c: [(f"q{draw.randrange(9)}", f"c{draw.randrange(12)}", draw.choice([0.25, 0.5, 0.5 + 1e-11, 0.75])) for _ in range(60)] for c in ("word", "postal", "prefix")}
    best, hits, first = defaultdict(lambda: [0.0] * 7), defaultdict(int), {}
    for channel, slot in blocking.ORDER:
        for s1, cid, score in made.get(channel, []):
            first.setdefault((s1, cid), blocking.NEW_PAIR.get(channel, (0.0,) * 7))
            hits[s1, cid] += 1
            best[s1, cid][slot] = max(best[s1, cid][slot], score)
    want = {}
    for q in {k[0] for k in best}:
        own = {k: tuple(map(max, v, first[k])) for k, v in best.items() if k[0] == q}
        order = sorted(own, key=lambda k: (-round(max(own[k]), 9), k[1]))
        want |= {k: (*own[k], hits[k], n + 1) for n, k in enumerate(order[:5])}
    got = blocking.ordered_union({c: spark.createDataFrame(rows, PAIR) for c, rows in made.items()}, 5).collect()
    assert {(r.s1, r.cid): (*(r[f"s_{c}"] for c in blocking.CHANNELS), r.channels_hit, r.rank) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], PAIR)
    assert blocking.simple_union({"word": empty, "addr": empty}, 5).columns == ["s1", "cid", "s_word", "s_addr", "score", "rank"]


def test_channels_are_tables_until_the_pairs_are(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(pipeline, "write_table", lambda df, tag: seen.append(tag) or tables.write_table(df, tag))
    own = pipeline.normal_records(records(spark, sf), config.BASELINE)
    assert pipeline.candidate_table(own, config.BASELINE).count() > 0
    assert seen == ["channel", "channel", "pairs"]


def test_products_of_vectors_where_pairs_meet(spark):
    draw = random.Random(2)
    vectors = [None, [0.0, 0.0, 0.0], [1.0]] + [[draw.random() - 0.5 for _ in range(3)] for _ in range(5)]
    rows = [(f"{side}{n}", side, v) for side in ("S1", "S2") for n, v in enumerate(vectors)]
    records_ = spark.createDataFrame(rows, "doc string, side string, v array<float>")
    pairs = spark.createDataFrame([(f"S1{a}", f"S2{b}") for a in range(8) for b in range(8)], "s1 string, cid string")
    both = features.paired(pairs, records_, dots={"x": "v"})
    assert both.where(F.col("x").isNull() != sm.dot(F.col("a_v"), F.col("b_v")).isNull()).count() == 0
    assert both.where(F.col("x") != sm.dot(F.col("a_v"), F.col("b_v"))).count() == 0 and both.where("x IS NOT NULL").count() > 30
