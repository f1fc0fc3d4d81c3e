import random

from helpers import WORDS, documents, empty, table

from kinlink.llm import automaton, suffixarray, windows


def plain(rows, split, join, w):
    first = {}
    toks = [(d, split(t or "")) for d, t, *_ in rows]
    for d, t in toks:
        if d is not None:
            for i in range(len(t) - w + 1):
                k = tuple(t[i : i + w])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in toks:
        gone = [False] * len(t)
        if d is not None:
            for i in range(len(t) - w + 1):
                if first[tuple(t[i : i + w])] < d:
                    gone[i : i + w] = [True] * w
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((-1 if d is None else d, len(t), sum(gone), runs, join([x for x, g in zip(t, gone) if not g])))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def by_bytes(rows, w=50):
    return plain(rows, lambda t: t.encode(), bytes, w)


def by_words(rows, w=50):
    return plain(rows, lambda t: t.encode().split(), b" ".join, w)


def test_bytes_as_plain_code_does(spark):
    rows = documents(4)
    assert found(suffixarray.dedup(table(spark, rows))) == by_bytes(rows)


def test_words_as_plain_code_does(spark):
    rows = documents(5)
    assert found(automaton.dedup(table(spark, rows))) == by_words(rows)
    assert found(automaton.dedup(table(spark, rows), 7, 3)) == by_words(rows, 7)


def test_hot_anchors_go_by_content(spark):
    rows = documents(6)
    own = table(spark, rows)
    assert found(windows.remove_repeats(own, windows.ByteTokens, 50, 20, suffixarray.repeated_spans, hot_packs=0)) == by_bytes(rows)
    assert found(windows.remove_repeats(own, windows.WordTokens, 50, 8, automaton.repeated_spans, hot_packs=0)) == by_words(rows)


def test_few_letters_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICE", 64)
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ab") * r.randint(1, 30) for _ in range(r.randint(1, 40))), None, None, None) for i in range(30)]
    rows += [(40, "z" * 3000, None, None, None), (41, "z" * 2000 + "y", None, None, None)]
    assert found(suffixarray.dedup(table(spark, rows))) == by_bytes(rows)


def test_empty_and_extra_columns(spark):
    assert suffixarray.dedup(empty(spark)).count() == 0
    assert automaton.dedup(empty(spark)).count() == 0
    clash = table(spark).selectExpr("*", "1 AS pack", "2 AS kind", "3 AS kept")
    assert found(suffixarray.dedup(clash)) == by_bytes(documents())


def test_maximal_repeats_have_all_occurrences():
    r = random.Random(8)
    for _ in range(60):
        pieces = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))).encode() for _ in range(r.randint(1, 5))]
        least = r.randint(2, 4)
        where = {}
        for p, s in enumerate(pieces):
            for i in range(len(s)):
                for j in range(i + least, len(s) + 1):
                    where.setdefault(s[i:j], set()).add((p, i))
        want = set()
        for s, at in where.items():
            # suffixes shorter than ``least`` do not stand in the array
            left = {pieces[p][i - 1] if i else (p, "start") for p, i in at}
            right = {pieces[p][i + len(s)] if i + len(s) < len(pieces[p]) else (p, i, "end") for p, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), frozenset(at)))
        got = {(n, frozenset(at)) for n, at in suffixarray.repeat_groups(pieces, least)}
        assert got == want


def test_automaton_statistics():
    r = random.Random(9)
    for _ in range(60):
        texts = [[r.choice(range(3)) for _ in range(r.randint(0, 15))] for _ in range(4)]
        own = automaton.SuffixAutomaton()
        for d, t in enumerate(texts):
            own.add(t, d)
        own.finish()
        for d, t in enumerate(texts):
            want = []
            for e in range(1, len(t) + 1):
                best = max((n for n in range(e + 1) if n == 0 or any(t[e - n : e] == u[i : i + n] for u in texts[:d] for i in range(len(u)))), default=0)
                if best >= 2:
                    want.append((e - best, e))
            assert own.matches(t, d, 2) == want
    assert len(WORDS) == 16


def test_long_maximal_repeats_come_whole():
    """Repeats far longer than a segment of the frame, with the occurrences of all."""
    r = random.Random(10)
    text = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    long, other = text(5000), text(700)
    pieces = [text(40) + b"X" + long + b"Y" + text(9), b"Z" + long + b"W" + other, text(300), b"Q" + long + b"V", b"P" + other]
    got = {(n, frozenset(at)) for n, at in suffixarray.repeat_groups(pieces, 50)}
    assert got == {(5000, frozenset({(0, 41), (1, 1), (3, 1)})), (700, frozenset({(1, 5002), (4, 1)}))}


def test_array_memory_follows_the_bytes_of_a_shard():
    import tracemalloc

    r = random.Random(11)
    body = bytes(r.choice(b"abcdefghijklmnop") for _ in range(1 << 20))
    for size in (112, 100_000):
        pieces = [body[i : i + size] for i in range(0, len(body), size)]
        tracemalloc.start()
        suffixarray.enhanced_array(pieces, 50)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 * len(body)  # 100 and four bytes more for each doubling, and what is sorted at a time


def test_sizes_follow_the_texts():
    for total in (0, 10**6, 10**10, 10**14):
        packs, buckets, shards = windows.sizes_for(total, 200)
        assert shards * windows.SHARD_BYTES >= total - windows.SHARD_BYTES and packs * (33 << 20) >= total and buckets >= 400
    # a row of anchors of a pack for a bucket stays worth sending
    assert (32 << 20) // windows.sizes_for(10**14, 200)[1] >= 256


def test_rows_between_packs_and_shards_follow_the_texts():
    """Packs send a row for each bucket and each tray: a hundred times the texts may not be 10,000 times the rows."""
    for partitions, total in ((85, 10**9), (600, 10**10), (3000, 5 * 10**10)):
        packs, buckets, shards = windows.sizes_for(total, partitions)
        trays = windows.trays_for(total, partitions)
        assert packs * (buckets + 2 * trays) < total / 900  # at 10**10 without trays and with a bucket for each MB: total / 220
        assert shards * windows.SHARD_BYTES >= total - windows.SHARD_BYTES and trays * windows.TRAY_BYTES > total - windows.TRAY_BYTES


def test_trays_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(windows, "trays_for", lambda total, partitions: 2)
    for hot in (0, 256):
        rows = documents(7 + hot)
        own = table(spark, rows)
        assert found(windows.remove_repeats(own, windows.ByteTokens, 50, 20, suffixarray.repeated_spans, hot_packs=hot)) == by_bytes(rows)
        assert found(windows.remove_repeats(own, windows.WordTokens, 50, 8, automaton.repeated_spans, hot_packs=hot)) == by_words(rows)
