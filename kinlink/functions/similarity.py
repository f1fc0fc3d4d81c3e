"""Similarities of two strings, sets or vectors.

Sets, Levenshtein and cosine are built-in expressions (sets and Levenshtein also go by distinct pairs, see features.paired). The ratios of longest common
subsequences, of matching blocks, and Jaro-Winkler have no built-in form: they are one Arrow
UDF, which takes distinct pairs of a batch once. Common subsequences are found for all pairs
of a batch at a time: a word of 64 bits is the row of a pair's table, and a step of numpy takes
in one character of every pair. Pairs whose shorter side is longer than a word go one by one.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence: one integer holds the row of the table, a bit for each character of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings are alike."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: common words against either side's words, and both sides with their common words first.

    One if there are common words and one side has no others; zero if a side has no words.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    left, right = " ".join(only_x), " ".join(only_y)
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    size_x, size_y = shared + gap + len(left), shared + gap + len(right)
    distance = len(left) + len(right) - 2 * lcs_length(left, right)
    best = 1 - distance / (size_x + size_y)
    if shared:
        best = max(best, 1 - (gap + len(left)) / (shared + size_x), 1 - (gap + len(right)) / (shared + size_y))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, or a shorter one at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    m, best = len(a), 0.0
    known = set(a)
    for start in range(1 - m, len(b)):
        window = b[max(start, 0) : start + m]
        # a window that ends (or at the right end, begins) in a foreign character is no better than its neighbour
        edge = window[0] if start + m > len(b) else window[-1]
        if edge in known and 2 * len(window) / (m + len(window)) > best:
            best = max(best, ratio(a, window))
            if best == 1.0:
                return best
    return best if len(a) != len(b) else max(best, _partial_swapped(b, a))


def _partial_swapped(a: str, b: str) -> float:
    m, best = len(a), 0.0
    for start in range(1 - m, len(b)):
        window = b[max(start, 0) : start + m]
        if 2 * len(window) / (m + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth for each of up to four common first characters where it is above 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    others = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(matched, others, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro > 0.7:
        same = 0
        while same < min(4, len(a), len(b)) and a[same] == b[same]:
            same += 1
        jaro += same * 0.1 * (1 - jaro)
    return jaro


def sequence_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks (the longest first, then on either side of it) over both lengths."""
    return difflib.SequenceMatcher(None, a, b).ratio()


# -- all pairs of a batch ------------------------------------------------------------------------
_WORD_BITS = 64
#: Cells of a table of character places, or of windows, that are held at a time.
_CELLS = 1 << 20


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, padded with zeros."""
    own = np.array(texts, dtype=str)
    return own.view(np.uint32).reshape(len(texts), -1) if own.itemsize else np.zeros((len(texts), 1), np.uint32)


def _tables(short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the places of each character in its short text as bits, and the long text's characters as columns of that.

    Column 0 is for padding and for characters that stand in no short text.
    """
    a, b = _codes(short), _codes(long)
    number = np.zeros(int(max(a.max(), b.max())) + 1, np.int32)
    number[np.unique(a)] = 1
    number[0] = 0
    number = np.where(number > 0, np.cumsum(number), 0).astype(np.int32)
    places = np.zeros((len(short), int(number.max()) + 1), np.uint64)
    rows = np.arange(len(short))
    for i in range(a.shape[1]):
        places[rows, number[a[:, i]]] |= np.uint64(1 << i)
    places[:, 0] = 0
    return places, number[b]


def lcs_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """lcs_length() of each pair."""
    out = np.zeros(len(x), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y, strict=True)]
    able = [k for k, (a, b) in enumerate(pairs) if a and len(a) <= _WORD_BITS and "\0" not in b and "\0" not in a]
    for k in set(range(len(pairs))).difference(able):
        out[k] = lcs_length(*pairs[k])
    able.sort(key=lambda k: len(pairs[k][1]))
    for at in range(0, len(able), _CELLS >> 8):
        own = able[at : at + (_CELLS >> 8)]
        places, b = _tables([pairs[k][0] for k in own], [pairs[k][1] for k in own])
        rows, row = np.arange(len(own)), np.full(len(own), np.iinfo(np.uint64).max)
        for j in range(b.shape[1]):
            hit = row & places[rows, b[:, j]]
            row = (row + hit) | (row - hit)
        out[own] = np.bitwise_count(~row)  # bits beyond the short text stay set
    return out


def _ratios(x: list[str], y: list[str]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in zip(x, y, strict=True)])
    return np.where(total > 0, 2 * lcs_lengths(x, y) / np.maximum(total, 1), 1.0)


def _token_sort_ratios(x: list[str], y: list[str]) -> np.ndarray:
    return _ratios([" ".join(sorted(a.split())) for a in x], [" ".join(sorted(b.split())) for b in y])


def _token_set_ratios(x: list[str], y: list[str]) -> np.ndarray:
    out = np.zeros(len(x))
    open_, left, right, shared = [], [], [], []
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        p, q = set(a.split()), set(b.split())
        both = p & q
        if p and q and both and (len(both) == len(p) or len(both) == len(q)):
            out[k] = 1.0
        elif p and q:
            open_.append(k)
            left.append(" ".join(sorted(p - q)))
            right.append(" ".join(sorted(q - p)))
            shared.append(sum(map(len, both)) + max(len(both) - 1, 0))
    if open_:
        n, m, common = (np.array(v) for v in ([len(t) for t in left], [len(t) for t in right], shared))
        gap = (common > 0).astype(int)
        size_x, size_y = common + gap + n, common + gap + m
        best = 1 - (n + m - 2 * lcs_lengths(left, right)) / (size_x + size_y)
        either = np.maximum(1 - (gap + n) / np.maximum(common + size_x, 1), 1 - (gap + m) / np.maximum(common + size_y, 1))
        out[open_] = np.where(common > 0, np.maximum(best, either), best)
    return out


def _window_ratios(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each short text with a window of its length in the long one, or a shorter one at an end."""
    out = np.zeros(len(short))
    by_size: dict[int, list[int]] = {}
    for k in sorted(range(len(short)), key=lambda k: len(long[k])):
        by_size.setdefault(len(short[k]), []).append(k)
    for m, every in by_size.items():
        step = max(1, _CELLS // (m + len(long[every[-1]])))
        for own in (every[at : at + step] for at in range(0, len(every), step)):
            places, b = _tables([short[k] for k in own], [long[k] for k in own])
            n = np.array([len(long[k]) for k in own])[:, None]
            # the places of each character of the long text, with room for windows that hang over its ends
            hits = np.zeros((len(own), b.shape[1] + 2 * (m - 1)), np.uint64)
            hits[:, m - 1 : m - 1 + b.shape[1]] = places[np.arange(len(own))[:, None], b]
            windows = b.shape[1] + m - 1
            row = np.full((len(own), windows), np.iinfo(np.uint64).max)
            for j in range(m):
                hit = row & hits[:, j : j + windows]
                row = (row + hit) | (row - hit)
            start = np.arange(windows)[None, :] - (m - 1)
            size = np.minimum(start + m, n) - np.maximum(start, 0)
            out[own] = np.where(size > 0, 2 * np.bitwise_count(~row) / (m + np.maximum(size, 1)), 0.0).max(axis=1)
    return out


def _partial_ratios(x: list[str], y: list[str]) -> np.ndarray:
    out = np.zeros(len(x))
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y, strict=True)]
    able = [k for k, (a, b) in enumerate(pairs) if a and len(a) <= _WORD_BITS and "\0" not in a and "\0" not in b]
    for k in set(range(len(pairs))).difference(able):
        out[k] = partial_ratio(*pairs[k])
    if able:
        out[able] = _window_ratios([pairs[k][0] for k in able], [pairs[k][1] for k in able])
        same = [k for k in able if len(pairs[k][0]) == len(pairs[k][1])]
        if same:
            out[same] = np.maximum(out[same], _window_ratios([pairs[k][1] for k in same], [pairs[k][0] for k in same]))
    return out


def _jaro_winklers(x: list[str], y: list[str]) -> np.ndarray:
    """jaro_winkler() of each pair: the places of y's characters are the bits of a word, and a step takes in one character of every x."""
    out = np.zeros(len(x))
    able = [k for k, (a, b) in enumerate(zip(x, y, strict=True)) if a and b and len(b) <= _WORD_BITS and "\0" not in a and "\0" not in b]
    for k in set(range(len(x))).difference(able):
        out[k] = jaro_winkler(x[k], y[k])
    able.sort(key=lambda k: len(x[k]))
    full, one = np.uint64(np.iinfo(np.uint64).max), np.uint64(1)
    for at in range(0, len(able), _CELLS >> 8):
        own = able[at : at + (_CELLS >> 8)]
        left, right = [x[k] for k in own], [y[k] for k in own]
        places, text = _tables(right, left)
        n, m = (np.array([len(t) for t in side]) for side in (left, right))
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        rows, taken = np.arange(len(own)), np.zeros(len(own), np.uint64)
        found = np.zeros(text.shape, bool)
        for i in range(text.shape[1]):
            first, end = np.maximum(i - reach, 0), np.minimum(m, i + reach + 1)
            within = np.where(first < end, (full >> (64 - end).astype(np.uint64)) & (full << np.minimum(first, 63).astype(np.uint64)), np.uint64(0))
            free = places[rows, text[:, i]] & within & ~taken
            free &= ~free + one  # the first of them
            taken |= free
            found[:, i] = free > 0
        a, b = _codes(left), _codes(right)
        common = found.sum(axis=1)
        row, _ = np.nonzero(found)
        other = (taken[:, None] >> np.arange(b.shape[1], dtype=np.uint64) & one).astype(bool)
        moved = np.bincount(row, a[:, : found.shape[1]][found] != b[other], len(own)).astype(np.int64) // 2
        jaro = np.where(common > 0, (common / n + common / m + (common - moved) / np.maximum(common, 1)) / 3, 0.0)
        same, so_far = np.zeros(len(own), np.int64), np.ones(len(own), bool)
        for i in range(min(4, a.shape[1], b.shape[1])):
            so_far &= (a[:, i] == b[:, i]) & (a[:, i] > 0)
            same += so_far
        out[own] = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    return out


def levenshtein(a: str, b: str) -> int:
    """Edits between two texts: two integers hold the differences along a column of the table."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, out = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        hit = places.get(c, 0)
        cross = ((hit & up) + up ^ up) | hit | down
        more, less = (down | ~(cross | up)) & full, up & cross
        out += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = (less | ~(cross | more)) & full, more & cross
    return out


def _levenshteins(x: list[str], y: list[str]) -> np.ndarray:
    """1 less the edits over the longer length of each pair; the rows of all tables go a character at a time."""
    size = np.array([max(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64)
    out = np.zeros(len(x), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y, strict=True)]
    able = [k for k, (a, b) in enumerate(pairs) if a and len(a) <= _WORD_BITS and "\0" not in b and "\0" not in a]
    for k in set(range(len(pairs))).difference(able):
        out[k] = levenshtein(*pairs[k])
    able.sort(key=lambda k: len(pairs[k][1]))
    one = np.uint64(1)
    for at in range(0, len(able), _CELLS >> 8):
        own = able[at : at + (_CELLS >> 8)]
        places, b = _tables([pairs[k][0] for k in own], [pairs[k][1] for k in own])
        n, m = (np.array([len(pairs[k][side]) for k in own]) for side in (0, 1))
        rows, last, edits = np.arange(len(own)), (n - 1).astype(np.uint64), n.copy()
        up, down = np.full(len(own), np.iinfo(np.uint64).max), np.zeros(len(own), np.uint64)
        for j in range(b.shape[1]):
            hit = places[rows, b[:, j]]
            cross = ((hit & up) + up ^ up) | hit | down
            more, less = down | ~(cross | up), up & cross
            edits += np.where(j < m, (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64), 0)
            more, less = more << one | one, less << one
            up, down = less | ~(cross | more), more & cross
        out[own] = edits
    return np.where(size > 0, 1 - out / np.maximum(size, 1), 1.0)


def _one_by_one(kernel):
    return lambda x, y: np.array([kernel(a, b) for a, b in zip(x, y, strict=True)], float)


KERNELS = {
    "ratio": _ratios,
    "token_sort_ratio": _token_sort_ratios,
    "token_set_ratio": _token_set_ratios,
    "partial_ratio": _partial_ratios,
    "jaro_winkler": _jaro_winklers,
    "sequence_ratio": _one_by_one(sequence_ratio),
    "levenshtein": _levenshteins,
}
USUAL = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "jaro_winkler")


def score_pairs(x: list, y: list, names: tuple[str, ...] = USUAL) -> dict[str, np.ndarray]:
    """The named similarities of each pair; all are zero where a side is null or empty."""
    known: dict[tuple, int] = {}
    at = np.array([known.setdefault((a, b), len(known)) if a and b else -1 for a, b in zip(x, y, strict=True)], np.int64)
    p, q = [a for a, _ in known], [b for _, b in known]
    return {n: np.append(KERNELS[n](p, q) if known else [], 0.0)[at] for n in names}


def string_similarities(a: Column, b: Column, names: tuple[str, ...] = USUAL) -> Column:
    """A struct of the named similarities; all are zero where a side is null or empty."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def score(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score_pairs(x.tolist(), y.tolist(), names))

    return score(a, b)


# -- built-in forms ----------------------------------------------------------------------------
def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; zero if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def tri_state(a: Column, b: Column, inside: bool = False) -> Column:
    """1 if equal (or, ``inside``, one within the other), -1 if not, 0 if one is missing."""
    same = a == b
    if inside:
        same = same | a.contains(b) | b.contains(a)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(same, F.lit(1.0)).otherwise(F.lit(-1.0))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, kept within 0 and 1; zero for a missing or zero vector."""
    return cosine_of(dot(a, b), dot(a, a), dot(b, b))


def cosine_of(product: Column, a: Column, b: Column) -> Column:
    """cosine() from the product of two vectors and their squares."""
    value = product / F.sqrt(a * b)
    return F.coalesce(F.when(F.isnan(value), F.lit(0.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def blend(**parts: tuple[float, Column]) -> Column:
    """A weighted sum of named scores."""
    terms = [F.lit(w) * c for w, c in parts.values()]
    return sum(terms[1:], terms[0])
