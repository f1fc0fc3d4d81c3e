import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinlink.operators import sparse
from kinlink.operators import vectorize as vz


def plain(rows, v, k):
    """Best k of each S1 document, ties to the lesser candidate, by nothing but loops."""
    n = Counter(c for _, _, c, _ in rows)
    tf: dict[tuple, Counter] = {}
    for doc, side, c, t in rows:
        tf.setdefault((c, doc, side), Counter()).update((t or "").lower().split())
    df = Counter((c, t) for (c, _, _), own in tf.items() for t in own)
    known = {x for x, m in df.items() if v.min_df <= m <= v.max_df * n[x[0]]}
    weights, square, size = {}, Counter(), Counter()
    for key, own in tf.items():
        c = key[0]
        weights[key] = {t: 1.0 if v.binary else (1 + math.log(m)) * (math.log((1 + n[c]) / (1 + df[c, t])) + 1) for t, m in own.items() if (c, t) in known}
        square[key[1]] += sum(w * w for w in weights[key].values())
        size[key[1]] += len(weights[key])
    out = []
    for s1 in {d for _, d, side in tf if side == "S1" and d is not None}:
        found = []
        for (c, d, side), a in weights.items():
            if (d, side) != (s1, "S1"):
                continue
            for (c2, cid, side2), b in weights.items():
                if c2 == c and side2 != "S1" and cid is not None and a.keys() & b.keys():
                    dot = sum(a[t] * b[t] for t in a.keys() & b.keys())
                    score = dot / (size[s1] + size[cid] - dot) if v.binary else dot / math.sqrt(square[s1] * square[cid])
                    found.append((-round(score, 9), cid))
        out += [(s1, cid, round(-low, 6), i + 1) for i, (low, cid) in enumerate(sorted(found)[:k])]
    return sorted(out)


def texts(n):
    words = ["apex", "blue", "corp", "delta", "east", "fox", "gold", "hill"]
    for i in range(n):
        text = " ".join(words[(i * 7 + j * j) % (3 + i % 6)] for j in range(i % 5))
        yield f"D{i:03d}", "S1" if i % 10 < 3 else "S2", "AB"[i % 4 // 3], None if i % 29 == 0 else text


ODD = [("D001", "S1", "B", "apex gold"), ("D015", "S2", "A", "blue blue fox"), ("D015", "S2", "A", "gold"), (None, "S1", "A", "apex"), (None, "S2", "A", "apex"), (None, "S2", "A", "fox")]


@pytest.mark.parametrize("binary", [False, True])
@pytest.mark.parametrize("odd", [False, True])
def test_best_products_against_loops(spark, monkeypatch, binary, odd):
    rows = list(texts(150)) + (ODD if odd else [])
    v = vz.Vectorizer(2, 0.8, 1000, 0, binary=binary)
    df = spark.createDataFrame(rows, "doc string, side string, country string, _x string")
    for block, piece in ((5, 40), (10_000, 1 << 20)):
        monkeypatch.setattr(sparse, "QUERIES", block)
        monkeypatch.setattr(sparse, "CORPUS", block)
        monkeypatch.setattr(sparse, "SLICE", piece)
        got = sorted((r.s1, r.cid, round(r.score, 6), r["rank"]) for r in sparse.best_products(df, vz.word_terms, v, 4).collect())
        assert got == plain(rows, v, 4)


def test_equal_texts_meet_as_one_class(spark):
    # 63 million pairs of records, and nine of classes
    df = spark.range(30_000).selectExpr("id AS doc", "IF(id % 10 < 3, 'S1', 'S2') AS side", "'X' AS country", "concat('name n', id % 3) AS _x")
    v = vz.Vectorizer(2, 1.0)
    table, members, split = sparse._weighted(df, vz.word_terms, v, 5, None)
    assert table.count() == 6 and members.count() == 9_000 and not split
    got = sparse.best_products(df, vz.word_terms, v, 5)
    assert got.count() == 45_000 and got.where("s1 % 3 <> cid % 3").isEmpty()
    assert [r.cid for r in got.where("s1 = 0").orderBy("rank").collect()] == [3, 6, 9, 15, 18]


def test_sampled_vocabulary_and_no_rows(spark):
    rows = [("a", "S1", "X", "one two", 1), ("b", "S2", "X", "one two", 2), ("c", "S2", "X", "two three", 3), ("d", "S3", "X", "two three", 4)]
    df = spark.createDataFrame(rows, "doc string, side string, country string, _x string, ord int")
    v = vz.Vectorizer(2, 1.0)
    got = {(r.s1, r.cid) for r in sparse.best_products(df, vz.word_terms, v, 5, F.col("ord") <= 2).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d")}
    assert {(r.s1, r.cid) for r in sparse.best_products(df, vz.word_terms, v, 5, F.col("ord") >= 3).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    assert sparse.best_products(df.limit(0), vz.word_terms, v, 5).count() == 0
