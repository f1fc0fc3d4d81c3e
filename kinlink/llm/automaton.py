"""Substring dedup with suffix automata of reference shards.

A shard's automaton takes the reference passages word by word; each state knows the smallest
document that its strings occur in. Passages are then streamed through it for matching
statistics: at each word the longest suffix that a document of smaller id holds. Maximal
matches of at least ``window`` words are removed.

What the shards are, and how passages get to them and spans back, is the frame in
windows.py: an automaton meets the passages of its shard through a shuffle, as references
grow with the corpus and have no bound that would allow a broadcast from the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .windows import WordTokens, remove_repeats

#: Words of a window, and of the k-grams that anchors are chosen from.
WINDOW, GRAM = 50, 8
NOBODY = 1 << 63


class SuffixAutomaton:
    """A generalised suffix automaton whose states carry the smallest owner of their strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [NOBODY]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(NOBODY)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                if self.length[q] != self.length[last] + 1:
                    q = self._split(last, c, q)
                last = q
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Pass owners up the suffix links, longest states first."""
        owner, link = self.owner, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if owner[s] < owner[link[s]]:
                owner[link[s]] = owner[s]

    def matches(self, words: list[int], before: int, least: int) -> list[tuple[int, int]]:
        """Ranges of the longest matches of ``least`` words or more that an owner below ``before`` holds."""
        out = []
        state = size = 0
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        for i, c in enumerate(words):
            while state and c not in nexts[state]:
                state = link[state]
                size = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                size += 1
            s, n = state, size
            while n >= least and owner[s] >= before:
                s = link[s]
                n = length[s]
            if n >= least:
                out.append((i + 1 - n, i + 1))
        return out


def repeated_spans(pieces: list[bytes], owners: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each piece the word ranges that a piece of a smaller owner holds too."""
    names: dict[bytes, int] = {}
    texts = [[names.setdefault(w, len(names)) for w in p.split(b" ")] for p in pieces]
    automaton = SuffixAutomaton()
    for words, owner in zip(texts, owners, strict=True):
        automaton.add(words, owner)
    automaton.finish()
    return [automaton.matches(words, owner, window) for words, owner in zip(texts, owners, strict=True)]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_tokens (words), n_removed, n_spans and kept (words joined by spaces); see remove_repeats()."""
    return remove_repeats(docs, WordTokens, window, gram, repeated_spans)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by dedup(): null texts have no words, rows without an id stay whole, repeated rows stay, extra columns are not read."""
    return dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
