import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinlink.operators import assign, decide, guards, knn, metrics, model, validate
from kinlink.operators import vectorize as vz
from kinlink.sources import files

EDGE = "s1 string, cid string, prob double"


def greedy(edges, capacity=None, group=lambda cid: 0):
    used, count, out = set(), Counter(), set()
    for s, c, p in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if c not in used and (capacity is None or count[s, group(c)] < capacity[group(c)]):
            used.add(c)
            count[s, group(c)] += 1
            out.add((s, c, p))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assignment_is_the_sequential_one(spark, seed):
    r = random.Random(seed)
    edges = {(f"S1-{r.randint(0, 9)}", f"S{r.choice('23')}-{r.randint(0, 30)}"): round(r.random(), 1) for _ in range(150)}
    edges = [(*k, p) for k, p in edges.items()]
    df = spark.createDataFrame(edges, EDGE).repartition(3)
    rows = lambda d: {tuple(x) for x in d.select("s1", "cid", "prob").collect()}
    assert rows(assign.uncapped(df)) == greedy(edges)
    assert rows(assign.capped(df, F.lit(2))) == greedy(edges, {0: 2})
    by_source = assign.capped_by_source(df.withColumn("is_s3", F.col("cid").startswith("S3-").cast("int")), 2, 1)
    got = rows(by_source)
    assert got == greedy(edges, {"2": 2, "3": 1}, lambda c: c[1])
    assert max(Counter(c for _, c, _ in got).values()) == 1


def test_empty_assignment(spark):
    assert assign.capped(spark.createDataFrame([], EDGE), F.lit(2)).count() == 0


def test_tfidf_against_plain_code(spark):
    r = random.Random(1)
    docs = [(f"d{i}", "S1" if i % 3 == 0 else "S2", "US", " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))) for i in range(60)]
    v = vz.Vectorizer(2, 0.5, 6, 0)
    df = spark.createDataFrame(docs, "doc string, side string, country string, t string").withColumn("_t", vz.word_terms(F.col("t")))
    counts = vz.term_counts(df, F.col("_t"))
    got = {(x.doc, x.term): x.w for x in vz.weights(counts, vz.vocabulary(counts, df, v), v).collect()}
    tf = {d: Counter(t.split()) for d, _, _, t in docs}
    n = len(docs)
    df_ = Counter(w for c in tf.values() for w in c)
    cf = Counter()
    for c in tf.values():
        cf.update(c)
    vocab = sorted((w for w in df_ if 2 <= df_[w] <= 0.5 * n), key=lambda w: (-cf[w], w))[:6]
    want = {}
    for d, c in tf.items():
        own = {w: (1 + math.log(c[w])) * (math.log((1 + n) / (1 + df_[w])) + 1) for w in c if w in vocab}
        norm = math.sqrt(sum(x * x for x in own.values()))
        want.update({(d, w): x / norm for w, x in own.items()})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_char_terms(spark):
    got = spark.createDataFrame([("ab  c",)], "t string").select(vz.char_terms(F.col("t"), 3, 4).alias("x")).first().x
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])


def test_metrics(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "s1 string, cid string")
    p = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "8")], "s1 string, cid string")
    row = metrics.macro(ids, t, p).first()
    f = 1.25 * 1 * 0.5 / (0.25 + 0.5)
    assert abs(row.f05 - (f + 0 + 1 + 0) / 4) < 1e-12 and row.perfect == 1 and row.zero == 2
    s = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.1, 0.0)], "prob double, label double")
    assert abs(metrics.auc(s).first().auc - 0.875) < 1e-12
    scored = spark.createDataFrame([("a", "1", 0.9), ("b", "1", 0.95), ("a", "2", 0.4)], EDGE)
    sweep = {x.tau: x.f05 for x in metrics.sweep(ids, t, scored, [0.3, 0.99]).collect()}
    for tau, value in sweep.items():
        kept = [(s, c) for s, c, q in greedy([tuple(x) for x in scored.collect() if x.prob >= tau])]
        df = spark.createDataFrame(kept, "s1 string, cid string")
        assert abs(metrics.macro(ids, t, df).first().f05 - value) < 1e-12


FACT = "entity_id string, src string, name string, addr string, hn string, pc string, state string, tokens array<string>"


def fact(i, name, addr, hn="", pc="", state=""):
    return (i, i[:2], name, addr, hn, pc, state, sorted(set(addr.lower().replace(",", "").split())))


def test_guards_in_order(spark):
    facts = spark.createDataFrame([
        fact("S1-1", "apex", "104 main st", "104", "75201"), fact("S2-1", "apex", "108 main st", "108", "75201"), fact("S2-2", "apex", "5-104 main st", "5", "75201"),
        fact("S2-3", "apex", "104 main st", "104", "90001"), fact("S2-4", "apex", "9 other road far", "", ""), fact("S1-2", "zeta", "aaaabbbb"), fact("S3-1", "omega", "xxxxyyyy"),
        fact("S1-3", "acme", ""), fact("S3-2", "acme", ""),
    ], FACT)
    m = spark.createDataFrame([("S1-1", f"S2-{k}", k) for k in (1, 2, 3, 4)] + [("S1-1", "S2-77", 5), ("S1-2", "S3-1", 1), ("S1-3", "S3-2", 1)], "s1 string, cid string, ord int")
    got = {(r.s1, r.cid): r.reason for r in guards.degree_cap(guards.marginal_singletons(guards.guarded(m, facts, chain=2)), 1, 6).collect()}
    assert got == {
        ("S1-1", "S2-1"): "premise", ("S1-1", "S2-2"): None, ("S1-1", "S2-3"): "postal", ("S1-1", "S2-4"): "chain", ("S1-1", "S2-77"): "degree",
        ("S1-2", "S3-1"): "singleton", ("S1-3", "S3-2"): None,
    }
    assert {r.reason: r.n for r in guards.telemetry(guards.harden(m, facts)).collect()}["kept"] >= 3


def test_combinations(spark):
    lex = spark.createDataFrame([("a", "1", 0.5), ("b", "1", 0.5)], "s1 string, cid string, score double")
    sem = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.8), ("b", "1", 0.9)], "s1 string, cid string, sem double")
    aim = spark.createDataFrame([("a",)], "s1 string")
    got = {k: {(r.s1, r.cid): round(r.score, 6) for r in decide.combine(lex, sem, k, aim).collect()} for k in "abc"}
    assert got == {"a": {("a", "1"): 0.9, ("b", "1"): 0.5}, "b": {("a", "1"): 0.9, ("a", "2"): 0.8, ("b", "1"): 0.5}, "c": {("a", "1"): 0.66, ("b", "1"): 0.5}}


def test_inverted_lists_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS s1", "embedding AS v")
    c = rows.where("vec_id % 10 <> 0").selectExpr("vec_id AS cid", "embedding AS v")
    best = {(r.s1, r.cid) for r in knn.exact(q, c, 5).collect()}
    near = {(r.s1, r.cid) for r in knn.inverted_lists(q, c, 5, 16, 12).collect()}
    assert len(best) == 5 * q.count() and len(best & near) >= 0.9 * len(best)


def test_folds_and_thresholds(spark):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(200)], "s1 string, x int").withColumn("f", model.fold(F.col("s1"), 5))
    assert df.select("f").distinct().count() == 5
    assert model.country_taus({"US": [(0.5, 0.8), (0.6, 0.9)]}, {"France": "US"}) == {"US": 0.6, "France": 0.63}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "S1-1", 'a "b"', "", "US"), (0, "S1-0", "c", "0012 x", "US")], "ord int, entity_id string, business_name string, business_address string, country string")
    path = str(tmp_path / "t.tsv")
    files.write_tsv(rows, path)
    assert [r.entity_id for r in files.read_tsv(spark, path).collect()] == ["S1-0", "S1-1"]
    assert sorted(tuple(r) for r in files.read_tsv(spark, path).collect()) == sorted(tuple(r)[1:] for r in rows.collect())
    part = next(p for p in (tmp_path / "t.tsv").iterdir() if p.name.startswith("part-"))
    files.pack([str(part)], str(tmp_path / "x.zip"))
    files.write_meta({"tau": 0.5}, str(tmp_path / "m.json"))
    assert files.read_meta(str(tmp_path / "m.json")) == {"tau": 0.5} and (tmp_path / "x.zip").stat().st_size > 0


def test_validator_fails_on_errors_only(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    good = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert validate.passed(validate.check_links(good, s1)).first().passed
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1")], "source1_entity_id string, matched_entity_ids string")
    found = {r.check: r.n for r in validate.check_links(bad, s1).collect()}
    assert found["duplicate_id"] == 1 and found["missing_row"] == 1
    assert not validate.passed(validate.check_links(bad, s1)).first().passed
