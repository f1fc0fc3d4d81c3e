import zlib

import numpy as np
from helpers import DOC, documents, empty, table

from kinlink.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op9_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_and_odd_rows(spark):
    docs = table(spark)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    got = langid.identify(docs.selectExpr("*", "1 AS score"), model).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)


def test_nothing_to_learn_from(spark):
    model = langid.train(empty(spark))
    assert langid.identify(empty(spark), model).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None, None, None)], DOC), model).collect()] == ["und"]


def test_held_out_labels_are_never_read(spark):
    rows = [(i, f"text number {i} with letters", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", None, None) for i in range(40)]
    assert langid.train(spark.createDataFrame(rows, DOC)).languages == ["yy"]
    assert documents()


def test_columns_are_the_landmarks_grams():
    model = langid.fit([("a", langid.presence("der die das")), ("b", langid.presence("the thing"))])
    for text in ("der thing ÄÖ", "", "x", "日本 the"):
        own = set(langid.presence(text).tolist()) & set(model.grams.tolist())
        cols = np.unique(np.concatenate(model.columns(langid._bytes(text))))
        assert set(model.grams[cols[cols < len(model.grams)]].tolist()) == own


def plain_scores(fitted, landmarks, texts, languages, ridge):
    """The same kernel machine in plain Python and dense algebra: kernels from sets, no tables of columns."""
    marks, grams, seen = [], set(), {}
    for lang, t in fitted:
        own = set(langid.presence(t).tolist())
        if seen.get(lang, 0) < landmarks:
            marks.append(own)
            grams |= own
        seen[lang] = seen.get(lang, 0) + 1
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = (vector / np.sqrt(np.maximum(value, langid.JITTER))) @ vector.T
    features = lambda ts: np.array([[kernel(set(langid.presence(t).tolist()) & grams, b) for b in marks] for t in ts]) @ root
    phi = features([t for _, t in fitted])
    y = np.array([[1.0 if lang == k else -1.0 for k in languages] for lang, _ in fitted])
    beta = np.linalg.solve(phi.T @ phi + ridge * len(fitted) / len(marks) * np.eye(len(marks)), phi.T @ y)
    return features(texts) @ beta


def test_scores_as_direct_kernel_ridge_gives():
    import random

    r = random.Random(3)
    words = {"a": ["der", "die", "und", "nicht", "über"], "b": ["the", "and", "of", "with"], "c": ["el", "los", "niño", "y"]}
    made = lambda k: " ".join(r.choice(words[k]) for _ in range(r.randint(1, 12)))
    fitted = sorted(((k, made(k)) for k in "abc" for _ in range(20)), key=lambda x: x[0])
    texts = [made(r.choice("abc")) for _ in range(100)] + ["xyz", "日本語 the", "The-Of 99 und"]
    model = langid.fit([(k, langid.presence(t)) for k, t in fitted], 6)
    want = plain_scores(fitted, 6, texts, model.languages, langid.RIDGE)
    names, scores, _ = model.predict(texts)
    assert np.allclose(scores, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)
    sure = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 1e-4
    assert [n for n, s in zip(names, sure, strict=True) if s] == [model.languages[k] for k, s in zip(want.argmax(axis=1), sure, strict=True) if s]


def test_accepted_are_texts_of_learnt_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rows = [(1, "Это предложение написано на русском языке", "en", None, None), (2, "日本語の文章です", None, None, None), (3, None, "en", "s", 1), (4, "!!! 123", "en", None, None), (5, "the house", None, None, None)]
    other = spark.createDataFrame(rows, DOC)
    assert [r.doc_id for r in langid.accepted(other, model).collect()] == [5]
    assert langid.accepted(docs, model).count() == docs.where(r"text rlike '\\p{L}'").count()
    assert sorted(r.doc_id for r in langid.accepted(other, langid.fit([])).collect()) == [1, 2, 5]


def test_repeated_ids_and_long_texts(spark):
    rows = [(7, f"the same words here {i}", "en", None, None) for i in range(30)] + [(8, "der und die " * 30_000, "de", None, None), (9, "das ist so", "de", None, None)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.train(docs, 5, 3)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id == 8} == {"de"}
