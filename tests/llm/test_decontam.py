import random
from collections import Counter

from helpers import WORDS, empty, sentence, table

from kinlink.llm import decontam as dc

ITEM = "item_id long, text string"


def plain(docs, items, n=5, least=0.8):
    def grams(w):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)])

    out = {}
    for d, t, *_ in docs:
        w = dc.words_of(t)
        for i, x in items:
            v = dc.words_of(x)
            if d is None or i is None or not v:
                continue
            want = grams(v)
            for a in range(len(w) - len(v) + 1):
                c = grams(w[a : a + len(v)])
                s = sum((c & want).values()) / sum((c | want).values())
                if s >= least and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, a)
    return out


def cases(seed):
    r = random.Random(seed)
    items = [(k, sentence(r, r.choice([2, 5, 7, 40, 100]))) for k in range(12)] + [(50, None), (51, ""), (None, "x y z"), (52, "!!!"), (3, sentence(r, 9))]
    docs = []
    for i in range(90):
        w = sentence(r, r.randint(0, 60)).split()
        if i % 2:
            own = (r.choice(items[:12])[1]).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = r.choice(WORDS)
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if i % 3 else x for x in own]
        docs.append((i, " ".join(w), None, None, None))
    return docs + [(100, None, None, None, None), (101, "", None, None, None), (None, items[0][1], None, None, None), docs[1]], items


def test_as_plain_code_does(spark, monkeypatch):
    docs, items = cases(1)
    bench = spark.createDataFrame(items, ITEM)
    want = plain(docs, items)
    assert len(want) > 10
    cut = dc.item_blocks
    for size in (dc.ITEM_BYTES, 60):  # one block of items, and many
        assert (len(list(cut(bench, size))) == 1) == (size > 100)
        monkeypatch.setattr(dc, "item_blocks", lambda items, size=size: cut(items, size))
        got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in dc.find_leaks(table(spark, docs), bench).collect()}
        assert got == want


def test_rows_that_stay(spark):
    docs, items = cases(2)
    kept = dc.drop_leaks(table(spark, docs), spark.createDataFrame(items, ITEM)).collect()
    leaked = {d for d, _ in plain(docs, items)}
    assert {r.doc_id for r in kept if r.doc_id is not None} == {d for d, *_ in docs if d is not None} - leaked
    assert dc.find_leaks(empty(spark), spark.createDataFrame(items, ITEM)).count() == 0
    assert dc.find_leaks(table(spark, docs), spark.createDataFrame([], ITEM)).count() == 0


def test_index_finds_all_within_the_radius():
    import numpy as np

    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([fps ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (0, 5, 15, 23, 30)])
    index = dc.MultiIndex(fps)
    got = set(index.search(near))
    want = {(q, i) for q, a in enumerate(near.tolist()) for i, b in enumerate(fps.tolist()) if (a ^ b).bit_count() <= dc.RADIUS}
    assert got == want


def test_documents_shorter_than_an_item(spark):
    r = random.Random(4)
    items = [(k, sentence(r, n)) for k, n in enumerate([3, 5, 6, 9, 30, 57, 57, 60, 100])]
    docs = []
    for _, x in items:
        w = x.split()
        docs += [(len(docs) + k, " ".join(part), None, None, None) for k, part in enumerate([w[: -(len(w) // 20 or 1)], w[len(w) // 12 :], w[1:-1], w[: len(w) // 2]])]
    want = {}
    for d, t, *_ in docs:
        w = dc.words_of(t)
        for i, x in items:
            v = dc.words_of(x)
            n, size = len(v), min(5, len(v))
            own = Counter(tuple(v[a : a + size]) for a in range(n - size + 1))
            for a in range(max(len(w) - n, 0) + 1):
                c = Counter(tuple(w[a : a + n][b : b + size]) for b in range(min(n, len(w)) - size + 1))
                s = sum((c & own).values()) / sum((c | own).values())
                if s >= 0.8 and s > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (s, a)
    assert len(want) >= 8
    bench = spark.createDataFrame(items, ITEM)
    assert {(x.doc_id, x.item_id): (x.similarity, x.start) for x in dc.find_leaks(table(spark, docs), bench).collect()} == want
    assert {x.doc_id for x in dc.drop_leaks(table(spark, docs), bench).collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_long_texts_and_clashing_columns(spark):
    r = random.Random(6)
    item = " ".join(f"q{r.randrange(10**6)}" for _ in range(40))
    words = [f"w{r.randrange(10**6)}" for _ in range(2 * dc.SLICE)]
    at = dc.SLICE + 500
    long = " ".join([*words[:at], *item.split(), *words[at:]])
    docs = table(spark, [(1, long, None, None, None), (2, " ".join(words), None, None, None), (3, None, None, None, None)])
    got = dc.find_leaks(docs.selectExpr("*", "1 AS similarity", "2 AS item_id", "3 AS start"), spark.createDataFrame([(9, item)], ITEM)).collect()
    assert [(x.doc_id, x.item_id, x.similarity, x.start) for x in got] == [(1, 9, 1.0, at)]
    same = " ".join(words[:3000])  # every word of the text is a hit, over several slices of pairs
    hit = dc.find_leaks(docs, spark.createDataFrame([(k, " ".join(words[k : k + 50])) for k in range(0, 3000, 100)], ITEM)).where("doc_id = 2").collect()
    assert len(hit) == 30 and all(x.start == x.item_id for x in hit) and same
