import zlib

from helpers import DOC, documents, empty, table

from kinlink.llm import sharding


def check(rows, got, shards, law):
    assert len(got) == len(rows)
    sizes, counts = [0] * shards, [0] * shards
    for r in got:
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    biggest = max(r["size"] for r in got)
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * biggest + 0.03 * sum(sizes) / shards
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_laws(spark):
    rows = documents(2)
    for law in ("bytes", "rows"):
        check(rows, sharding.place(sharding.records(table(spark, rows)), 5, law).collect(), 5, law)


def test_a_hot_group_is_subdivided(spark):
    rows = [(i, "same text " * 20 if i % 3 else f"own text {i} " * 15, None, None, None) for i in range(400)]
    got = sharding.place(sharding.records(spark.createDataFrame(rows, DOC)), 8).collect()
    check(rows, got, 8, "bytes")


def test_small_groups_stay_together(spark):
    rows = [(i, f"text of a group {i // 3}", None, None, None) for i in range(6000)]
    got = sharding.place(sharding.records(spark.createDataFrame(rows, DOC)), 8).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(v) > 1 for v in by.values()) <= 2


def test_many_splitters(spark):
    rows = sharding.records(table(spark, documents(7))).collect()
    points = sorted((r.h, r.doc_id or 0) for r in rows)
    df = spark.createDataFrame([(r.h, r.doc_id or 0) for r in rows], "h long, _d long").withColumn("range", sharding.range_of(points))
    for r in df.collect():
        assert r.range == sum(p <= (r.h, r._d) for p in points)


def test_native_plan_and_empty(spark, sf):
    out = sharding.op10_sharding(spark, sf)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.place(sharding.records(empty(spark)), 8).count() == 0


def test_rows_without_an_id_are_parted_too(spark):
    rows = [(None, "the same text of all " * 4, None, None, None)] * 400 + [(i, f"{i} " * 9, None, None, None) for i in range(100)]
    got = sharding.place(sharding.records(spark.createDataFrame(rows, DOC)), 4).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    assert all(sorted(s for s, _ in own) == list(range(len(own))) for own in sizes.values())
    totals = [sum(x for _, x in own) for own in sizes.values()]
    assert len(got) == 500 and len(totals) == 4 and max(totals) - min(totals) <= 200


def plain_place(rows, shards):
    """The law of bytes by one sorted list: an equal text stays whole if it is small, else its records go where their middles lie."""
    total = sum(s for *_, s in rows)
    groups, out, at = {}, {}, 0
    for h, d, s in sorted(rows):
        groups.setdefault(h, []).append((d, s))
    for h in sorted(groups):
        own, begin = groups[h], at
        size = sum(s for _, s in own)
        for d, s in own:
            middle = begin + size / 2 if size <= sharding.SNAP * total / shards else at + s / 2
            out[d] = min(int(middle * shards // total), shards - 1)
            at += s
    return out


def test_as_a_plain_placement(spark, sf):
    own = sharding.records(spark.read.parquet(f"{sf}/documents.parquet"))
    want = plain_place([(r.h, r.doc_id, r.size) for r in own.collect()], 8)
    assert {r.doc_id: r.shard for r in sharding.place(own, 8).collect()} == want
