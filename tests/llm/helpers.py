"""Fixtures with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi"]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def documents(seed=0):
    """Copies, near copies, shared passages and lines, and odd rows; ids are not in order."""
    r = random.Random(seed)
    passage, line = sentence(r, 60), "Subscribe to our Newsletter today"
    out = []
    for i in range(40):
        parts = [sentence(r, r.randint(3, 80)) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), passage)
        if i % 4 == 0:
            parts.append(line.upper() if i % 8 else f"  {line}\t")
        out.append("\n".join(parts))
    out += [out[1], out[1], out[2] + " end", out[5].replace("alpha", "omega", 1)]
    out += ["", None, "   \n\t", "a", "é" * 70, "ab" * 400, "ab" * 300, "Ünïcode 日本語 🙂 " * 12, "x y", "!!! 123"]
    ids = list(range(len(out)))
    r.shuffle(ids)
    rows = [(i, t, r.choice(["en", "de", None]), "src", None) for i, t in zip(ids, out, strict=True)]
    return rows + [rows[3], (None, out[0], "en", "src", 1), (None, None, None, None, None)]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
