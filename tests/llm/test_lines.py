import hashlib

from helpers import DOC, documents, empty, table
from pyspark.sql import functions as F

from kinlink.llm import lines

SPACE = " \t\n\v\f\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    owner = {}
    for d, t, *_ in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                k = x.strip(SPACE).translate(LOW)
                if len(k) >= 10:
                    owner[k] = min(owner.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or owner.get(x.strip(SPACE).translate(LOW), d) == d]
        out.append((-1 if d is None else d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(df):
    rows = df.select(F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    return sorted(tuple(r) for r in rows)


def test_as_plain_code_does(spark):
    rows = documents(1)
    for batches in (1, 3, 7):
        assert found(lines.dedup(table(spark, rows), batches)) == plain(rows)


def test_columns_stay_and_clashes_are_replaced(spark):
    docs = table(spark).selectExpr("*", "'x' AS n_lines", "1 AS h1", "array(1) AS `drop`")
    out = lines.dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert found(out) == plain(documents())
    assert lines.dedup(empty(spark)).count() == 0


def test_later_batches_meet_the_runs(spark):
    runs = lines.Runs(fanout=2)
    rows = [(i, f"a common line here\nown line number {i} of its kind", None, None, None) for i in range(12)]
    for a in range(0, 12, 3):
        part = spark.createDataFrame(rows[a : a + 3], DOC)
        got = {r.doc_id: r.text for r in lines.dedup(part, 1, runs).collect()}
        for i, text in got.items():
            assert text == rows[i][1] if i == 0 else text == f"own line number {i} of its kind"
    assert len(runs.tables()) <= 2  # compacted
    assert sum(r.count() for r in runs.tables()) == 13


def test_results_outlive_the_runs_they_were_made_with(spark):
    line = "a line that both of them hold"
    one = spark.createDataFrame([(1, line, None, None, None)], DOC)
    two = spark.createDataFrame([(2, f"{line}\nmore of it here", None, None, None)], DOC)
    three = spark.createDataFrame([(3, "more of it here\nx", None, None, None)], DOC)
    runs = lines.Runs()
    a, b, c = (lines.dedup(x, 1, runs) for x in (one, two, three))
    assert [r.text for r in a.collect()] == [line] and [r.text for r in b.collect()] == ["more of it here"] and [r.text for r in c.collect()] == ["x"]
    runs.drop()
    assert runs.tables() == []


def test_long_texts(spark):
    text = "\n".join(f"line number {i % 5000} of them" for i in range(60_000))
    got = lines.dedup(spark.createDataFrame([(1, text, None, None, None), (2, text, None, None, None)], DOC)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(60_000, 0), (60_000, 60_000)]
