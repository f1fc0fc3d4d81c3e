import random
import re

import xxhash
from helpers import Sets, documents, empty, table

from kinlink.llm import simhash as sh


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for _, t, *_ in documents():
        assert sh.fingerprint(sh.shingle_hashes(t, 3)) == plain_fingerprint(t)


def test_tree_finds_what_a_scan_finds():
    r = random.Random(1)
    keys = [r.getrandbits(64) for _ in range(50)]
    keys += [k ^ (1 << r.randint(0, 63)) ^ (1 << r.randint(0, 63)) for k in keys for _ in range(4)]
    tree = sh.BKTree()
    for k in keys:
        tree.add(k)
    for k in keys[::7]:
        for radius in (0, 3, 20):
            assert sorted(tree.search(k, radius)) == sorted({x for x in keys if (x ^ k).bit_count() <= radius})


def fingerprint_rows(seed, n=120):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    out = []
    for i in range(n):
        f = r.choice(base)
        for _ in range(r.randint(0, 4)):
            f ^= 1 << r.randint(0, 63)
        out.append((r.choice([i, i, i // 2]), sh.signed(f)))
    return out


def test_links_with_and_without_cut_shards(spark, monkeypatch):
    for cap in (4096, 2):
        rows = [(i, f) for i, (_, f) in enumerate(fingerprint_rows(cap))]
        by_fp = Sets()
        for i, (_, f) in enumerate(rows):
            for _, g in rows[:i]:
                if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3:
                    by_fp.union(f, g)
        least = {}
        for d, f in rows:
            least[by_fp.find(f)] = min(least.get(by_fp.find(f), d), d)
        if cap == 2:
            monkeypatch.setattr(sh, "TREE", 3)  # pairs of chunks too
        got = sh.linked(spark.createDataFrame(rows, "doc_id long, fp long"), 3, cap).collect()
        assert {x.doc_id: x.component_id for x in got} == {d: least[by_fp.find(f)] for d, f in rows}


def test_odd_rows(spark):
    docs = table(spark).withColumnRenamed("source", "fp")
    got = sh.linked(sh.fingerprints(docs)).collect()
    assert len(got) == docs.count()
    blank = [x for x in got if x.fp == 0]
    assert len(blank) >= 3 and len({x.component_id for x in blank}) == 1
    assert sh.linked(sh.fingerprints(empty(spark))).count() == 0
    assert sh.near_duplicates(empty(spark)).count() == 0


def plain_near(rows):
    sets = Sets()
    grams = [(d, set(sh.shingle_hashes(t, 5).tolist())) for d, t, *_ in rows if d is not None]
    for i, (a, x) in enumerate(grams):
        sets.find(a)
        for b, y in grams[:i]:
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                sets.union(a, b)
    return {d: sets.find(d) for d, _ in grams}


def test_near_duplicates_as_all_pairs_say(spark, sf, monkeypatch):
    rows = documents(3)
    assert {x.doc_id: x.component_id for x in sh.near_duplicates(table(spark, rows)).collect()} == plain_near(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_near([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {x.doc_id: x.component_id for x in sh.near_duplicates(docs).collect()} == want
    kept = {x.doc_id for x in sh.keep_first(docs).collect()}
    assert kept == {d for d, c in want.items() if c == d}


def test_large_clusters_and_shards_lose_no_link(spark, monkeypatch):
    """Chains and groups of near copies over many chunks; those at one edge only link through a single pair."""
    monkeypatch.setattr(sh, "TREE", 16)
    monkeypatch.setattr(sh, "VERIFY", 4)
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = []
    for _ in range(3):
        base, other = [word() for _ in range(150)], [word() for _ in range(60)]
        for k in range(25):
            own = list(base)
            for _ in range(r.choice((1, 2, 3, 4))):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
            if k % 4 == 0:
                rows.append(" ".join(own[: 75 + r.randrange(20)] + other))
        for k in range(12):
            rows.append(" ".join(base[8 * k : 8 * k + 100]))
    rows = [(i, t, None, None, None) for i, t in enumerate(rows)]
    want = plain_near(rows)
    assert 3 < len(set(want.values())) < len(rows)
    assert {x.doc_id: x.component_id for x in sh.near_duplicates(table(spark, rows)).collect()} == want


def test_full_shards_of_each_block_lose_no_link(spark):
    """Over TREE fingerprints share a block's value, and pairs at 1 to 3 bits lie in every block but that one."""
    r = random.Random(31)
    for block in range(4):
        at, fill = 16 * block, r.getrandbits(16)
        pin = lambda f: f & ~(0xFFFF << at) & (1 << 64) - 1 | fill << at  # noqa: B023, E731
        others = [b for b in range(64) if not at <= b < at + 16]
        fps = [pin(r.getrandbits(64)) for _ in range(sh.TREE + 300)]
        pairs = []
        for f in fps[:200]:
            g = f
            for b in r.sample(others, r.randint(1, 3)):
                g ^= 1 << b
            pairs.append((f, g))
        fps += [g for _, g in pairs] + [fps[0] ^ (1 | 1 << 20 | 1 << 32) if block == 3 else fps[0]]
        got = sh.linked(spark.createDataFrame([(i, sh.signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")).collect()
        component = {x.fp: x.component_id for x in got}
        assert all(component[sh.signed(f)] == component[sh.signed(g)] for f, g in pairs)
        assert component[sh.signed(fps[-1])] == component[sh.signed(fps[0])]


def test_repeated_ids_with_other_fingerprints(spark):
    got = sh.linked(spark.createDataFrame([(1, 0), (1, 255 << 40), (7, 3), (9, (255 << 40) + 1), (None, 3)], "doc_id long, fp long")).collect()
    assert len(got) == 5 and {x.component_id for x in got} == {1}


def test_near_duplicates_with_repeats_and_short_texts(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = []
    for k in range(12):
        shared, passage = [word() for _ in range(204)], [word() for _ in range(10)]
        for many in (50, 1 if k % 2 else 0):
            rows.append((len(rows), " ".join(shared + passage * many), None, None, None))
    for _ in range(300):
        short = [word() for _ in range(9)]
        rows += [(len(rows) + k, " ".join(x), None, None, None) for k, x in enumerate((short, short[:8]))]
    assert {x.doc_id: x.component_id for x in sh.near_duplicates(table(spark, rows)).collect()} == plain_near(rows)
