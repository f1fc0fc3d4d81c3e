import difflib
import random

import pytest

from kinlink.functions import similarity as sm

PLAIN = {
    "ratio": sm.ratio, "token_sort_ratio": sm.token_sort_ratio, "token_set_ratio": sm.token_set_ratio, "partial_ratio": sm.partial_ratio,
    "jaro_winkler": sm.jaro_winkler, "sequence_ratio": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(),
}


def pairs(seed, n=600):
    r = random.Random(seed)
    words = ["acme", "motors", "ünïon", "बैंक", "main", "st", "street", "12", "a", "b", "🙂", "international"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 4, 6, 14))))
    out = []
    for _ in range(n):
        a = text()
        b = text() if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.8)
        out.append((a, b))
    return out + [(None, "x"), ("x", None), ("", "x"), ("a\0b", "a\0"), ("ab", "ba"), ("a" * 64, "a" * 64), ("a" * 65, "ba" * 40), ("  ", " x ")]


@pytest.mark.parametrize("name", list(PLAIN))
def test_batches_as_one_by_one(name):
    own = pairs(3)
    got = sm.score_pairs([a for a, _ in own], [b for _, b in own], (name,))[name]
    for (a, b), g in zip(own, got.tolist(), strict=True):
        assert g == pytest.approx(PLAIN[name](a, b) if a and b else 0.0, abs=1e-12), (a, b)


def test_empty_batch():
    assert len(sm.score_pairs([], [])["ratio"]) == 0
