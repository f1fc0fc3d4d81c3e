import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as sm
from kinlink.operators import features
from kinlink.plans import config, pipeline

WORDS = ["acme", "motors", "ünïon", "बैंक", "12", "a", "b", "🙂"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_levenshtein_of_all_pairs_of_a_batch():
    draw = random.Random(5)
    texts = ["", "a", "ab ab", "é\0x", "b" * 64, "ab" * 40, "🙂b"] + ["".join(draw.choice("abcé ") for _ in range(draw.randint(1, 70))) for _ in range(40)]
    x, y = zip(*((a, b) for a in texts for b in texts), strict=True)
    want = [edits(a, b) for a, b in zip(x, y, strict=True)]
    assert [sm.levenshtein(a, b) for a, b in zip(x, y, strict=True)] == want
    longest = np.array([max(len(a), len(b), 1) for a, b in zip(x, y, strict=True)])
    assert np.array_equal(sm._levenshteins(list(x), list(y)), 1 - np.array(want) / longest)


@pytest.mark.parametrize("looked_up", [3, 1 << 20])
def test_values_are_compared_where_pairs_meet(spark, monkeypatch, looked_up):
    monkeypatch.setattr(features, "LOOKED_UP", looked_up)
    draw = random.Random(7)

    def row(n, side):
        bag = draw.choice([None, [], [draw.choice(WORDS) for _ in range(draw.randint(1, 6))]])
        return f"{side}{n}", side, draw.choice([None, "", "acme motors", " ".join(draw.choices(WORDS, k=3))]), bag, [draw.choice(WORDS)]

    rows = [row(n, side) for side in ("S1", "S2") for n in range(40)]
    own = {r[0]: r for r in rows}
    pairs = [(f"S1{a}", f"S2{b}") for a in range(40) for b in range(40) if (a + b) % 3]
    records = spark.createDataFrame(rows, "doc string, side string, name string, u array<string>, v array<string>")
    common = {"x": ("u", "u"), "z": ("u", "v")}
    made = features.paired(spark.createDataFrame(pairs, "s1 string, cid string"), records, ("u", "v"), ("name",), common, {"n": ("name", ("ratio", "levenshtein"))}, ("u", "v", "name"))
    assert made.columns == ["cid", "s1", "a_side", "b_side", "x", "z", "n_ratio", "n_levenshtein"]
    got = {(r.s1, r.cid): (r.x, r.z, r.n_ratio, r.n_levenshtein) for r in made.collect()}

    def shared(a, b):
        return None if a is None or b is None else len(set(a) & set(b))

    def alike(a, b):
        return (sm.ratio(a, b), 1 - edits(a, b) / max(len(a), len(b))) if a and b else (0.0, 0.0)

    want = {(a, b): (shared(own[a][3], own[b][3]), shared(own[a][3], own[b][4]), *alike(own[a][2], own[b][2])) for a, b in pairs}
    assert got == want


def test_sets_with_one_digest_stay_apart(monkeypatch):
    import pyarrow as pa

    lists = pa.array([[1, 2], [2, 1], None, [3], []], pa.list_(pa.int32()))
    assert features._Bags(lists).of.tolist()[:3:2] == [features._Bags(lists).of[1], -1]
    monkeypatch.setattr(features, "_MIX", 0)
    assert len(set(features._Bags(lists).of.tolist())) == 5


def test_pairs_carry_no_sets(spark):
    """Sets and long texts of records stay in their block: only numbers go on with a pair."""
    schema = "doc string, side string, country string, is_s3 double, name_norm string, addr_norm string, name_clean string, name_spaceless string, first_word string, hn string, pc string, city string, state string, "
    schema += "name_words array<string>, addr_tokens array<string>, nums array<string>, name_trigrams array<string>"
    records = spark.createDataFrame([], schema)
    pairs = spark.createDataFrame([], "s1 string, cid string")
    made = features.dense_pairs(pairs, records, config.V2.features)
    assert not [f.name for f in made.schema if f.dataType.typeName() == "array" or f.name in ("a_name_norm", "b_addr_norm")]
    assert pipeline.features is features and made.where(F.lit(True)).count() == 0


def test_rescored_pairs_carry_no_sets(spark):
    records = spark.createDataFrame([("S1-1", "S1", "US", "Acme Inc", "1 Main St 12345"), ("S2-1", "S2", "US", "ACME", "1 Main St 12345")], "doc string, side string, country string, name_raw string, addr_raw string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1)], "s1 string, cid string, rank int")
    made = features.rescore_pairs(pairs, records)
    assert not [f.name for f in made.schema if f.dataType.typeName() == "array"]
    (row,) = features.rescore_35(made).collect()
    assert (row.name_word_jaccard, row.addr_word_jaccard, row.addr_levenshtein_sim, row.name_word_diff) == (0.5, 1.0, 1.0, 1.0)
