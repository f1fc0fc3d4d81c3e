from kinlink.operators import knn


def test_equal_vectors_meet_once(spark, monkeypatch):
    met, products = [], knn.products
    monkeypatch.setattr(knn, "products", lambda q, c, k: met.append((q.count(), c.count())) or products(q, c, k))
    q = spark.createDataFrame([(n, "x", [1.0, 0.0]) for n in range(20)], "s1 long, country string, v array<float>")
    c = spark.createDataFrame([(n, "x", [1.0, float(n % 2)]) for n in range(30)], "cid long, country string, v array<float>")
    got = knn.exact(q, c, 17, "country").collect()
    assert met == [(1, 2)]
    near = [*range(0, 30, 2), 1, 3]
    assert sorted((r.s1, r.rank, r.cid) for r in got) == [(n, k + 1, x) for n in range(20) for k, x in enumerate(near)]
