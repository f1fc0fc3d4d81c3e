import random

import numpy as np
from helpers import Sets

from kinlink.llm import egojoin as ego

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, cosine=0.98):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    sets, links = Sets(), [0] * len(ok)
    for a, (i, x, v) in enumerate(ok):
        for b, (j, y, w) in enumerate(ok):
            if a != b and x == y and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine:
                links[a] += 1
                sets.union(i, j)
    out = [(i, n, sets.find(i)) for (i, *_), n in zip(ok, links)]
    rest = [(i, 0, i) for i, lab, v in rows if not (i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v))]
    return sorted(((-1 if i is None else i), n, (-1 if c is None else c)) for i, n, c in [*out, *rest])


def vectors(seed, n=150, size=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, size))
    rows = []
    for i in range(n):
        v = base[r.integers(6)] + r.normal(size=size) * r.choice([0, 0.02, 0.1, 0.4])
        rows.append((int(i), int(r.integers(2)), [float(np.float32(x)) for x in v]))
    rows += [(n + k, 0, rows[0][2]) for k in range(20)]
    rows += [(300, None, rows[0][2]), (301, 0, None), (302, 0, [0.0] * size), (303, 0, [float("nan")] * size), (304, 0, [float("inf")] * size), (305, 0, [1.0, None] + [0.0] * (size - 2)), (306, 0, []), (307, 1, [1.0, 2.0]), (308, 1, [1.0, 2.0]), (None, 0, rows[0][2])]
    random.Random(seed).shuffle(rows)
    return rows


def found(df):
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, (-1 if r.component_id is None else r.component_id)) for r in df.collect())


def test_as_all_pairs_say(spark, monkeypatch):
    rows = vectors(1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(ego.near_duplicates(df)) == plain(rows)
    monkeypatch.setattr(ego, "BLOCK", 16)  # several blocks of a cell
    assert found(ego.near_duplicates(df.selectExpr("*", "1 AS v", "2 AS cls"))) == plain(rows)


def test_kept_and_empty(spark):
    got = ego.near_duplicates(spark.createDataFrame(vectors(2), SCHEMA)).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert ego.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intervals_skip_only_distant_ones(monkeypatch):
    r = np.random.default_rng(3)
    cells = r.integers(0, 6, size=(300, 3))
    cells = cells[np.lexsort(cells.T[::-1])]
    monkeypatch.setattr(ego, "SMALL", 8)
    seen = np.zeros((300, 300), bool)

    def mark(a0, a1, b0, b1):
        seen[a0:a1, b0:b1] = True
        seen[b0:b1, a0:a1] = True

    ego.interval_join(cells, mark, True)
    near = (np.abs(cells[:, None] - cells[None]) <= 1).all(axis=2)
    assert (seen | ~near).all() and not seen.all()
