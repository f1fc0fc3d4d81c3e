import numpy as np
from pyspark.sql import functions as F

from kinlink.operators import knn, metrics, model
from kinlink.plans import config, pipeline, registry
from kinlink.sources.records import records


def every(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    q = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS s1", "embedding AS v")
    return q, rows.selectExpr("vec_id AS cid", "embedding AS v")


def others(df):
    """Pairs without a query's own row, which any probe finds."""
    return {(r.s1, r.cid) for r in df.collect() if r.s1 != r.cid}


def test_registered_lists_and_defaults_recall(spark, sf):
    q, c = every(spark, sf)
    best = others(knn.exact(q, c, 10))
    for got in (registry.QUERIES["blk15_inverted_lists"](spark, sf), knn.inverted_lists(q, c, 10)):
        near = others(got)
        assert len(best & near) >= 0.9 * len(best)
    assert any(cid % 10 == 0 for _, cid in best)


def test_neighbours_of_a_preset_recall(spark, sf):
    own = pipeline.normal_records(records(spark, sf), config.V4).select("country", "doc", "side", F.col("name_vector").alias("v")).cache()
    got = {(r.s1, r.cid) for r in pipeline.neighbours(own, config.V4.neighbours).collect()}
    rows, best = own.collect(), set()
    for country in {r.country for r in rows}:
        corpus = sorted((r for r in rows if r.country == country and r.side != "S1"), key=lambda r: r.doc)
        m = np.array([r.v for r in corpus], float)
        for q in (r for r in rows if r.country == country and r.side == "S1"):
            score = np.round(m @ np.array(q.v, float), 6)
            best |= {(q.doc, corpus[k].doc) for k in np.argsort(-score, kind="stable")[:10]}
    # two sides that break ties by rounded scores may differ in a few
    assert len(got) == len(best) and len(got & best) >= 0.9 * len(best)


def plain_nearest(q, c, k):
    out = []
    for s1, kq, x in q:
        if kq is None:
            continue
        near = sorted((-round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1.0)), 9), cid) for cid, kc, y in c if kc == kq)
        out += [(s1, cid, n + 1) for n, (_, cid) in enumerate(near[:k])]
    return sorted(out)


def test_blocks_of_a_key_meet_whole(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "SLICE", 5)
    rng = np.random.default_rng(3)
    corpus = [(f"c{n:03d}", ["a", "a", "a", "b", None][n % 5], [float(v) for v in rng.integers(-1, 2, 3)]) for n in range(150)]  # many ties, zero vectors too
    queries = [(n, ["a", "b", "only here", None][n % 4], [1.0, float(n % 3), -1.0]) for n in range(80)]
    c = spark.createDataFrame(corpus, "cid string, country string, v array<float>")
    q = spark.createDataFrame(queries, "s1 long, country string, v array<float>")
    got = sorted((r.s1, r.cid, r["rank"]) for r in knn.exact(q, c, 7, "country").collect())
    assert got == plain_nearest(queries, corpus, 7)
    whole = sorted((r.s1, r.cid, r["rank"]) for r in knn.exact(q, c, 200).collect())  # more than there are
    assert whole == plain_nearest([(a, 0, v) for a, _, v in queries], [(a, 0, v) for a, _, v in corpus], 200)
    assert knn.exact(q.limit(0), c, 3).count() == 0 and knn.exact(q, c.limit(0), 3).count() == 0


def test_auc_in_ranges_of_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(float(p), float(rng.random() < p)) for p in np.round(rng.random(2000), 3)]
    pos, neg = [p for p, y in rows if y], np.array([p for p, y in rows if not y])
    want = sum((neg < p).sum() + (neg == p).sum() / 2 for p in pos) / (len(pos) * len(neg))
    assert abs(metrics.auc(spark.createDataFrame(rows, "prob double, label double")).first().auc - want) < 1e-12


def test_sampled_negatives_draw_from_the_hash_order(spark):
    docs = [(f"S2-{n}", "S2", "US" if n % 3 else "India") for n in range(200)] + [(f"S1-{n}", "S1", "US" if n % 2 else "India") for n in range(20)]
    own = spark.createDataFrame(docs, "doc string, side string, country string")
    hashes = {r.doc: (r.h, r.country) for r in own.where("side = 'S2'").selectExpr("doc", "country", "xxhash64(42, doc) AS h").collect()}
    order = {c: sorted((h, d) for d, (h, at) in hashes.items() if at == c) for c in ("US", "India")}
    draws = own.where("side = 'S1'").selectExpr("doc", "country", "explode(array(1, 2, 3)) AS d").selectExpr("doc", "country", "xxhash64(42, doc, d) AS h").collect()
    want = {(r.doc, order[r.country][r.h % len(order[r.country])][1]) for r in draws}
    none = spark.createDataFrame([], "s1 string, cid string")
    assert {(r.s1, r.cid) for r in model.sampled_negatives(own, none, 3).collect()} == want
