import random
import re
import time

import numpy as np
from helpers import documents, empty, table

from kinlink.llm import boosting, pii


def plain(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_on_random_texts():
    r = random.Random(5)
    bits = ["a", "@", ".", "1", "23", "+", "-", " ", "(", "4", "@a.b", "999", "1.2.3.4", "+1", "4111 1111 1111 1111", "é"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_trees_add_spans_and_leave_plain_numbers():
    model = pii.trained()
    for text, n in [
        ("Call me: (555) 123-4567 now", 1), ("mail bob (at) foo (dot) com ok", 1), ("card 4111.1111.1111.1111 x", 1), ("order 1234567 then", 0),
        ("version 10.2.3, 2020-01-02", 0), ("the year 1999 - 2004 and 12,000.50", 0),
    ]:
        assert len(pii.all_spans(text, pii.base_spans(text), model)) == n, text


def test_held_out_accuracy():
    trees, (a, b), _ = pii.trained()
    x, y = pii.training_cases(1500, seed=7)
    p = 1 / (1 + np.exp(-(a * trees.score(x) + b)))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97


def test_boosting_learns_a_threshold():
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 1] > 0.2).astype(float)
    model = boosting.BoostedTrees(20, 2).fit(x, y)
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.99
    assert boosting.precise_threshold(np.array([0.9, 0.8, 0.7]), np.array([1, 0, 1]), 0.9) == 0.9


def test_spans_of_documents(spark):
    rows = documents() + [(900, "Tel +1 (743) 555-3824, a.b@c.de 10.0.0.255, 4111-1111-1111-1111", None, None, None)]
    got = pii.find(table(spark, rows)).collect()
    assert len(got) == len(rows)
    last = next(r for r in got if r.doc_id == 900)
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    assert last.redacted == "Tel [phone], [email] [ip], [card]"
    assert pii.find(empty(spark)).count() == 0


def test_long_texts_stay_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 200_000, "1." * 150_000):
        pii.all_spans(t, pii.base_spans(t), pii.trained())


def test_each_written_form_is_found():
    model = pii.trained()
    forms = {
        "email": ["{}(at){}.com", "{} (at) {} (dot) com", "{}[at]{}[dot]com", "{} at {} dot com", "{}@{} dot com"],
        "ip": ["[.]", "(.)", "[dot]", " . "],
        "card": ["", ".", "/", "  ", " - "],
        "phone": ["(555) 123-4567", "555-123-4567", "555.123.4567", "555 123 4567", "0049 555 1234567", "(555)123-4567"],
    }
    made = [("email", f.format("smith", "example")) for f in forms["email"]]
    made += [("ip", s.join(("10", "0", "200", "1"))) for s in forms["ip"]]
    made += [("card", s.join(("4111", "1111", "1111", "1111"))) for s in forms["card"]]
    made += [("phone", x) for x in forms["phone"]]
    cues = {"email": "email", "ip": "host", "card": "visa", "phone": "phone"}
    for kind, x in made:
        text = f"please note {cues[kind]}: {x}, then go"
        a = text.index(x)
        assert (a, a + len(x), kind) in pii.candidates(text) + pii.base_spans(text), text
        assert any(s[2] == kind and s[0] <= a + 1 and s[1] >= a + len(x) - 1 for s in pii.all_spans(text, pii.base_spans(text), model)), text
    text = "please note phone: 555 123 4567 1234 5678, then go"
    assert (19, 31, "phone") in pii.candidates(text)
    assert any(s[2] == "phone" and s[0] < 31 for s in pii.all_spans(text, pii.base_spans(text), model))


def test_prose_is_left():
    for text in ("we meet at noon. Then they go home", "points 1. 2. 3. 4. are done", "look at home. The end", "Arrive at eight. We left"):
        assert pii.all_spans(text, [], pii.trained()) == [], text


def test_secrets_are_found_and_names_left():
    model = pii.trained()
    for text, n in [
        ('and token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" of', 1), ("API_KEY=9233A8ECF7C5B09FE5949719B6B82BC439E9329B now", 1),
        ("see /usr/share/doc/package_10_notes/readme2", 0), ("the meeting_notes_2024_final_12 file", 0), ("internationalisation1 of it", 0),
    ]:
        assert sum(k == "secret" for *_, k in pii.all_spans(text, pii.base_spans(text), model)) == n, text


def plain_all(text, model):
    """Each candidate against each span, likeliest first."""
    base = pii.base_spans(text)
    trees, (a, b), least = model
    scored = []
    for c in pii.candidates(text):
        if not any(c[0] < e and s < c[1] for s, e, _ in base):
            scored.append((1 / (1 + np.exp(-(a * float(trees.score(np.array([pii.features(text, c)]))[0]) + b))), c))
    added = []
    for q, c in sorted(scored, key=lambda x: (-x[0], x[1])):
        if q >= least[c[2]] and not any(c[0] < e and s < c[1] for s, e, _ in added):
            added.append(c)
    return sorted([*base, *added], key=lambda s: (s[0], pii.ADDED.index(s[2]), s[1]))


def test_all_spans_as_a_plain_version_says():
    model, r, seen = pii.trained(), random.Random(15), 0
    bits = [
        "call", "phone:", "card", "email", "token =", "555-123-4567", "(555) 123-4567", "4111.1111.1111.1111", "a.b@c.de", "bob (at) foo (dot) com", "10[.]0[.]0[.]1",
        '"b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "2020-01-02", "order", "12 34 56", "+1 743 555 3824", "x",
    ]
    for _ in range(300):
        text = r.choice((" ", "", ", ")).join(r.choice(bits) for _ in range(r.randint(1, 9)))
        got = pii.all_spans(text, pii.base_spans(text), model)
        assert got == plain_all(text, model), text
        seen += len(got) > len(pii.base_spans(text))
    assert seen > 50


def test_many_numbers_and_spans_in_one_text():
    text = " ".join(f"{i % 900 + 100} a{i}@x.com call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(8000))
    began = time.time()
    got = pii.all_spans(text, pii.base_spans(text), pii.trained())
    assert len(got) >= 8000 and time.time() - began < 20
