"""Personal data by boosted trees over candidate spans.

Generators of high recall propose overlapping spans: plain forms, and written-out or
defanged ones. Boosted trees score each from its format and its context; the scores are
calibrated on held-out cases, and a kind's threshold is the least chance at which held-out
precision is PRECISION. Trees are trained here, on cases made from the rules in training_cases()
(SEED and CASES fix them), not on the documents. Spans of the base rules stay whatever
the trees say; the trees add spans that overlap no base span: other forms of the four kinds, and secrets
(tokens, keys, passwords), for which there is no base rule.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, platt, precise_threshold
from .common import read_table, slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, in the order they are listed in.
ADDED = (*KINDS, "secret")
SEED, CASES, PRECISION = 20240611, 6000, 0.995

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always ends with its run of digits, so no match starts within one
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Local part, "@", labels; found from each "@" so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by start and then kind."""
    out = list(_emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            # the length alone settles runs that are too short or far too long
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], ADDED.index(s[2]), s[1]))


AT = re.compile(r"@|\(at\)|\[at\]|(?<=\s)at(?=\s)", re.I)
WRITTEN_HOST = re.compile(r"\s{0,2}[A-Za-z0-9-]{1,63}")
WRITTEN_LABEL = re.compile(r"\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}", re.I)
DEFANGED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])", re.I)
NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,}(?![0-9])")
GROUP = re.compile(r"[+(]{0,2}([0-9]+)")
#: Runs that a key or token may be; those of letters or digits alone are none.
OPAQUE = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
HEX = re.compile(r"[0-9a-fA-F]+")
ASSIGNED = re.compile(r"[:=][\s#$%&*!]*[\"']?$")
LETTERS = re.compile(r"[A-Za-z]")


def _written_emails(text: str) -> Iterator[Span]:
    """Local part, a sign or word for "@", and two to seven labels; found from each such sign."""
    for m in AT.finditer(text):
        stop = m.start()
        for _ in range(2):
            stop -= stop > 0 and text[stop - 1].isspace()
        start = stop
        while start > 0 and stop - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        end = WRITTEN_HOST.match(text, m.end()) if start < stop else None
        for _ in range(6 if end else 0):
            end = WRITTEN_LABEL.match(text, end.end())
            if not end:
                break
            yield start, end.end(), "email"


def _numbers(text: str) -> Iterator[Span]:
    """Runs of digits, and the stretches of whole groups within those that are too long for a phone number."""
    for m in NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if n <= 15:
            groups, lone = [(m.start(), m.end(), n)], True
        else:
            groups, lone = [(g.start(), g.end(), len(g[1])) for g in GROUP.finditer(text, m.start(), m.end())], False
        for k, (start, _, _) in enumerate(groups):
            held = 0
            for _, end, size in groups[k:] if lone else groups[k : k + 19]:
                held += size
                if held > 19:
                    break
                if 7 <= held <= 15:
                    yield start, end, "phone"
                if 13 <= held <= 19:
                    yield start, end, "card"


def candidates(text: str) -> list[Span]:
    """Spans of high recall; they overlap each other and the base spans."""
    out: list[Span] = []
    out += _written_emails(text)
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "secret") for m in OPAQUE.finditer(text) if DIGIT.search(m[0]) and LETTERS.search(m[0])]
        out += [(m.start(), m.end(), "ip") for m in DEFANGED_IP.finditer(text)]
        out += _numbers(text)
    return out


#: Cue words of the context (fixed values).
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "cc", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "whatsapp"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "api"),
}
#: How keys of well-known services begin (fixed values).
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "pk_", "xox")
AGAINST = ("isbn", "order", "invoice", "version", "id", "no", "ref", "serial", "sku", "date", "total", "price", "page", "section", "tracking")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
CONTEXT = 40


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    a, b, kind = span
    s = text[a:b]
    digits = _digits(s)
    before = [w.lower() for w in WORD.findall(text[max(0, a - CONTEXT) : a])][-4:]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    low = s.lower()
    turns = sum(c.isdigit() != d.isdigit() for c, d in zip(s[:512], s[1:512], strict=False))
    labels = re.split(r"\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?", low)
    return [
        ADDED.index(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(luhn(digits)) if digits else 0.0, s.count("-"), s.count(" "), s.count("."), s.count("/"), float("(" in s and ")" in s), float(s[0] == "+"), float(s[0] == "("),
        float(groups[-3:] == [3, 3, 4] or groups[-2:] == [3, 4]), float(len(set(groups)) == 1 and len(groups) > 1), float(digits[:1] in "3456" and digits != ""),
        float(len(set(digits)) <= 2), float("@" in s), float("(at)" in low or "[at]" in low), float(" at " in low), float("dot" in low or "[.]" in low or "(.)" in low),
        float(2 <= len(labels[-1]) <= 4 and labels[-1].isalpha()), float(max(map(int, (g[:9] for g in re.findall(r"[0-9]+", s))), default=0) <= 255),
        float(any(w in CUES[kind] for w in before)), float(any(w in AGAINST for w in before)), float(a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-./#$€")),
        float(b < len(text) and (text[b].isalnum() or text[b] in "-/%€")),
        turns / len(s), len(set(s[:512])) / min(len(s), 512), len(digits) / len(s), float(HEX.fullmatch(s) is not None), float(s != low and s != s.upper()),
        float(ASSIGNED.search(text[max(0, a - 8) : a]) is not None), float("/" in s or "_" in s), float(s.startswith(PREFIXES)),
    ]


def training_cases(count: int = CASES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of candidates in made sentences, half personal data and half numbers or words like it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14, 15)) - 1)
        last = next(str(k) for k in range(10) if luhn(d + str(k)))
        d += last if valid else str((int(last) + r.randint(1, 9)) % 10)
        sep = r.choice(("", ".", "/", "  ", " - "))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{num(2)} {a} {b}{c}", f"({a}){b}{c}"))

    def email() -> str:
        at, dot = r.choice((("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", " dot ")))
        return f"{word()}{r.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'info'))}"

    def ip() -> str:
        return r.choice(("[.]", "(.)", "[dot]", " . ")).join(str(r.randint(0, 255)) for _ in range(4))

    def secret() -> str:
        drawn = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
        some = r.choice(("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz"))
        made = drawn(some, r.choice((18, 24, 32, 40, 64)))
        if r.random() < 0.3:
            start = r.choice(PREFIXES)
            made = start + (drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) if start.isupper() else made)
        return made if DIGIT.search(made) and LETTERS.search(made) else secret()

    def opaque() -> str:
        """What looks like a secret and is none: names of files and products, joined words, checksums, identifiers."""
        return r.choice((
            lambda: f"{word()}_{word()}_{word()}_{num(2)}", lambda: f"{word()}/{word()}/{word()}{num(3)}/{word()}", lambda: f"{word()}-{word()}-{num(4)}-{num(2)}-{num(2)}",
            lambda: f"{word()}{word()}{word()}{word()}{num(1)}", lambda: f"{num(8)}-{num(4)}-4{num(3)}-a{num(3)}-{num(10)}ab", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        ))()

    def noise() -> str:
        return r.choice((
            lambda: num(r.randint(7, 19)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 999)}.{num(3)}.{num(3)}",
            lambda: f"{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: f"{num(4)}/{num(4)}", lambda: f"{num(3)}.{num(4)} {num(3)}.{num(4)}", lambda: f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}",
            lambda: f"{word()} at {word()} . {word()}", lambda: f"{word()} at dot {word()} dot", lambda: card(False), lambda: f"{num(2)} {num(3)} {num(2)} {num(4)} {num(1)}",
            lambda: r.choice(("[.]", " . ")).join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"{word()} at {word()}. {word()}",
            lambda: ". ".join(str(r.randint(1, 40)) for _ in range(4)),
        ))()

    x, y = [], []
    makers = {"email": email, "ip": ip, "card": lambda: card(True), "phone": phone, "secret": secret}
    while len(x) < count:
        kind = r.choice(ADDED)
        good = r.random() < 0.5
        made = makers[kind]() if good else opaque() if kind == "secret" else noise()
        # bare numbers are personal only where the context says so
        cue = r.choice(CUES[kind]) if good and (kind in ("card", "phone", "secret") or r.random() < 0.6) else r.choice((*AGAINST, word(), word())) if not good else word()
        more = f" {num(4)} {num(4)}" if good and kind == "phone" and r.random() < 0.2 else ""
        if good and kind == "secret":
            if made.startswith(PREFIXES) and r.random() < 0.5:
                cue = word()  # they need no cue
            cue += r.choice((' = "', "=", ": ", " = ", ": '")) if cue in CUES[kind] else " "
        text = f"{word()} {word()} {cue}{r.choice((' ', ': ')) if kind != 'secret' or not good else ''}{made}{more}{r.choice((' ', '. ', ', '))}{word()} {word()}"
        a = text.index(made)
        for s in candidates(text):
            true = good and s[2] == kind and s[0] >= a - 1 and s[1] <= a + len(made) + 1 and s[1] - s[0] >= 0.9 * len(made)
            if not good or true or s[2] != kind:
                x.append(features(text, s))
                y.append(float(true))
    return np.array(x), np.array(y)


@lru_cache(1)
def trained() -> tuple[BoostedTrees, tuple[float, float], dict[str, float]]:
    """The trees, their calibration, and each kind's threshold; trees see two thirds of the cases."""
    x, y = training_cases()
    held = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    a, b = platt(score := trees.score(x[held]), y[held])
    p = 1 / (1 + np.exp(-(a * score + b)))
    least = {k: precise_threshold(p[own], y[held][own], PRECISION) if (own := x[held][:, 0] == n).any() else 1.01 for n, k in enumerate(ADDED)}
    return trees, (a, b), least


def all_spans(text: str, base: list[Span], model) -> list[Span]:
    """Base spans and those that the trees add; of added ones that overlap, the likeliest and then first stays."""
    starts, ends = [s for s, _, _ in base], [0]
    for _, e, _ in base:
        ends.append(max(ends[-1], e))
    found = [c for c in candidates(text) if ends[bisect_left(starts, c[1])] <= c[0]]
    if not found:
        return base
    trees, (a, b), least = model
    p = 1 / (1 + np.exp(-(a * trees.score(np.array([features(text, c) for c in found])) + b)))
    added: list[Span] = []  # by start; none overlap
    for q, c in sorted(zip(p.tolist(), found, strict=True), key=lambda x: (-x[0], x[1])):
        if q >= least[c[2]]:
            at = bisect_left(added, c)
            if (at == 0 or added[at - 1][1] <= c[0]) and (at == len(added) or c[1] <= added[at][0]):
                added.insert(at, c)
    return _ordered([*base, *added])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the hole."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base and spans as text, and the redacted text.

    Spans are "kind:start:end" in code points, joined by commas, by start and then kind. Null
    texts are empty. Rows are judged one by one, repeats and null ids too.
    """
    model = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts: list[list[int]] = [[] for _ in (*KINDS, "all")]
            base_, spans_, texts = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, base, model)
                counts[-1].append(len(spans))
                for k, c in zip(KINDS, counts[:-1], strict=True):
                    c.append(sum(s[2] == k for s in base))
                base_.append(_said(base))
                spans_.append(_said(spans))
                texts.append(redact(text, spans))
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (base_, spans_, texts))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base string, spans string, redacted string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by find(): null texts are empty, repeated rows stay, extra columns are not read."""
    got = find(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")
