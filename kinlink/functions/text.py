"""Text normalisation as column expressions.

A rule is a chain of plain steps. The same chain gives a Spark column and a SQL expression
for checking, so the two cannot drift apart in their patterns. Patterns keep to what Java's
and RE2's syntax share. ``strict`` versions keep known quirks of older data (prefixes that
match inside words); the default asks for a word boundary.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def quote(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Chain:
    """Steps on one string: ("lower",), ("trim",), ("sub", pattern, replacement), ("ascii",), ("indic",), ("script",), ("missing",)."""

    steps: tuple

    def __add__(self, other: Chain) -> Chain:
        return Chain(self.steps + other.steps)

    def col(self, c: Column | str) -> Column:
        c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
        for step in self.steps:
            kind = step[0]
            if kind == "lower":
                c = F.lower(c)
            elif kind == "trim":
                c = F.trim(c)
            elif kind == "sub":
                c = F.regexp_replace(c, step[1], step[2].replace("\\", "$"))
            elif kind == "missing":
                c = F.when(F.lower(c).isin("nan", "null", "none"), F.lit("")).otherwise(c)
            elif kind == "ascii":
                c = _ascii(c)
            elif kind == "indic":
                c = _letters(c, indic_table())
            elif kind == "script":
                c = _letters(c, script_table())
        return c

    def sql(self, x: str) -> str:
        x = f"coalesce({x}, '')"
        for step in self.steps:
            kind = step[0]
            if kind in ("lower", "trim"):
                x = f"{kind}({x})"
            elif kind == "sub":
                x = f"regexp_replace({x}, {quote(step[1])}, {quote(step[2])}, 'g')"
            elif kind == "missing":
                x = f"(CASE WHEN lower({x}) IN ('nan', 'null', 'none') THEN '' ELSE {x} END)"
            elif kind == "ascii":
                x = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
            else:
                table = indic_table() if kind == "indic" else script_table()
                said = "[" + ", ".join(map(quote, table)) + "]"
                x = (
                    f"(CASE WHEN regexp_matches({x}, '[ऀ-ൿ]') THEN array_to_string(list_transform(string_split({x}, ''), "
                    f"lambda c: CASE WHEN unicode(c) BETWEEN {0x900} AND {0xD7F} THEN list_extract({said}, unicode(c) - {0x900 - 1}) "
                    f"WHEN unicode(c) < 128 THEN c ELSE {quote(' ') if kind == 'indic' else 'c'} END), '') ELSE {x} END)"
                )
        return x


def sub(pattern: str, to: str = "") -> Chain:
    return Chain((("sub", pattern, to),))


LOWER, TRIM, ASCII, MISSING = Chain((("lower",),)), Chain((("trim",),)), Chain((("ascii",),)), Chain((("missing",),))
INDIC, SCRIPT = Chain((("indic",),)), Chain((("script",),))
COLLAPSE = sub(r"\s+", " ") + TRIM
#: Python's [^\w\s] over Unicode: combining marks are no word characters.
NOT_WORD = sub(r"[^\p{L}\p{N}_\s]", " ")
NOT_WORD_ASCII = sub(r"[^a-zA-Z0-9_\s]", " ")


@lru_cache(1)
def accent_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that decompose to one ASCII character, those, and the ones that decompose to several.

    Made from the Unicode data of the Latin, compatibility and letter-like blocks.
    """
    one, to, many = [], [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(cp)
        base = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(base) == 1:
            one.append(c)
            to.append(base)
        elif base:
            many.append((c, base))
    return "".join(one), "".join(to), tuple(many)


def _ascii(c: Column) -> Column:
    one, to, many = accent_table()
    plain = F.translate(c, one, to)
    several = plain
    for x, base in many:
        several = F.replace(several, F.lit(x), F.lit(base))
    odd = "[" + "".join(x for x, _ in many) + "]"
    plain = F.when(plain.rlike(odd), several).otherwise(plain)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"[^\x00-\x7F]", "")).otherwise(c)


@lru_cache(1)
def indic_table() -> tuple[str, ...]:
    """For each code point from U+0900 to U+0D7F its letters: Telugu by itself, other blocks (of 128) by their places in Devanagari's."""
    out = []
    for cp in range(0x900, 0xD80):
        telugu = 0xC00 <= cp < 0xC80
        out.append(fixed.TELUGU_LETTERS.get(cp, "") if telugu else fixed.DEVANAGARI_LETTERS.get(0x900 + cp % 0x80, ""))
    return tuple(out)


@lru_cache(1)
def script_table() -> tuple[str, ...]:
    """For the same code points, letters from their Unicode names: consonants without their vowel, signs and digits."""
    out = []
    for cp in range(0x900, 0xD80):
        name = unicodedata.name(chr(cp), "")
        word = name.rpartition(" ")[2].lower()
        if unicodedata.digit(chr(cp), None) is not None:
            out.append(str(unicodedata.digit(chr(cp))))
        elif "VOWEL SIGN" in name:
            out.append(word)
        elif " LETTER " in name and word.isalpha():
            out.append(word[:-1] if word.endswith("a") and word.strip("aeiou") else word)
        else:
            out.append("n" if name.endswith("ANUSVARA") or name.endswith("CANDRABINDU") else "")
    return tuple(out)


def _letters(c: Column, table: tuple[str, ...]) -> Column:
    letters = F.array(*map(F.lit, table))
    other = F.lit(" ") if table is indic_table() else None

    def one(x: Column) -> Column:
        cp = F.ascii(x)
        return F.when(cp.between(0x900, 0xD7F), F.element_at(letters, cp - F.lit(0x900 - 1))).when(cp < 128, x).otherwise(x if other is None else other)

    return F.when(c.rlike("[ऀ-ൿ]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


# -- rules ---------------------------------------------------------------------------------
MARKS = sub(r"^(?:--|<<|>>|\.\.)\s*")
#: Lower case, one leading mark off, web endings off, words only.
BASIC = Chain((("missing",),)) + LOWER + TRIM + MARKS + sub(fixed.DOMAINS_BASE) + NOT_WORD + COLLAPSE
#: BASIC's start, suffix words out, apostrophes and hyphens kept.
NAME_SUFFIXES = LOWER + TRIM + MARKS + sub(fixed.DOMAINS_BASE) + sub("(?i)" + "|".join(fixed.SUFFIX_WORDS), " ") + sub(r"[^\p{L}\p{N}_\s'-]", " ") + COLLAPSE


def _rewrites(pairs: tuple) -> Chain:
    out = Chain(())
    for pattern, to in pairs:
        out += sub(pattern, to)
    return out


#: Short street words written out, words of nearness out.
ADDRESS = LOWER + TRIM + _rewrites(fixed.STREET_SHORT) + NOT_WORD + sub(fixed.NEAR_WORDS, " ") + COLLAPSE
#: Legal and trade words out, for names.
DEEP = LOWER + TRIM + sub(fixed.PREFIX_DEEP) + MARKS + sub(fixed.DOMAINS_BASE) + sub("(?i)" + fixed.LEGAL_DEEP) + NOT_WORD + COLLAPSE


def prefixes(words: str = fixed.PREFIX_WORDS, strict: bool = False) -> Chain:
    """Noise in front of a name: marks, or one of some words. By default words end at a boundary, and two go."""
    marks = r"^[.\-<>#@*_~\s]+"
    if strict:
        return sub(rf"(?i){marks}|^(?:{words})\s*[:\-]?\s*")
    once = sub(rf"(?i){marks}|^(?:{words})\b\s*[:\-]?\s*")
    return once + once


def universal(version: int = 3, strict: bool = False) -> Chain:
    """The normaliser of version 1 to 3: letters to Latin, accents off, prefixes and web endings off, words written out."""
    street = fixed.STREET_V3 if version == 3 else fixed.STREET_V1
    legal = fixed.LEGAL_REWRITES_V3 if version == 3 else fixed.LEGAL_REWRITES_V1
    domains = fixed.DOMAINS_V1 if version == 1 else fixed.DOMAINS_V3
    letters = INDIC if version == 1 else SCRIPT
    zeros = sub(r"\b0+([0-9]+)\b", r"\1")
    return MISSING + letters + ASCII + LOWER + prefixes(strict=strict) + sub(domains) + NOT_WORD_ASCII + zeros + _rewrites(street) + _rewrites(legal) + COLLAPSE


def clean_name(version: int = 3, strict: bool = False) -> Chain:
    """universal() without the legal terms."""
    out = universal(version, strict)
    for term in fixed.LEGAL_TERMS_V3 if version == 3 else fixed.LEGAL_TERMS_V1:
        out += sub(rf"\b{term}\b")
    return out + COLLAPSE


def leet() -> Chain:
    """Digits between letters read as letters; matches do not overlap."""
    out = Chain(())
    for digit, letter in ("0o", "1i", "3e", "4a", "5s"):
        out += sub(rf"([a-z]){digit}([a-z])", rf"\1{letter}\2")
    return out


#: Names for the rule engine.
RULE_NAME = (
    MISSING + INDIC + LOWER + TRIM + ASCII + prefixes(fixed.PREFIX_WORDS_RULES, strict=True) + sub(fixed.DOMAINS_V1)
    + sub("(?i)" + fixed.LEGAL_RULES) + NOT_WORD_ASCII + COLLAPSE + leet()
)
#: Names for rescoring: legal words out, marks and space collapsed.
RESCORE_NAME = TRIM + LOWER + sub("(?i)" + fixed.LEGAL_RESCORE) + TRIM + sub(r"[.\-<>#@*_~\s]+", " ") + TRIM


def spaceless(normal: Column) -> Column:
    return F.regexp_replace(normal, "[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_set(text: Column) -> Column:
    """Distinct tokens longer than one character, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda x: F.length(x) > 1)))


def first_word(text: Column) -> Column:
    return F.coalesce(F.get(tokens(text), F.lit(0)), F.lit(""))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def composite(name: Column, address: Column) -> Column:
    """The name twice and the address."""
    return F.trim(F.concat_ws(" ", name, name, address))


def char_ngrams(text: Column, n: int, joined: bool = False) -> Column:
    """Distinct character n-grams, sorted. ``joined``: blanks become "_", and a short text is its one gram."""
    if joined:
        text = F.lower(F.replace(text, F.lit(" "), F.lit("_")))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    short = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text)) if joined else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.when(F.length(text) >= n, grams).otherwise(short)))


def phonetic_keys(normal: Column) -> Column:
    """Consonant skeletons of the first three words of more than one character, as a sorted set."""
    words = F.slice(F.filter(F.split(normal, r"\s+"), lambda x: F.length(x) > 1), 1, 3)
    keys = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "[aeiouhw]", ""), r"(.)\1+", "$1"))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def numeric_tokens(normal: Column) -> Column:
    """Distinct tokens with a digit, leading zeros off, sorted."""
    out = F.transform(F.filter(tokens(normal), lambda x: x.rlike("[0-9]")), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.array_sort(F.array_distinct(F.filter(out, lambda x: x != "")))


def prefix_key(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def legal_suffix(raw: Column) -> Column:
    """The rewrite of the first legal form found in a raw name; empty if there is none."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    out = F.lit("")
    for pattern, to in reversed(fixed.LEGAL_REWRITES_V3):
        out = F.when(low.rlike(pattern), F.lit(to)).otherwise(out)
    return out


SCRIPTS = (("devanagari", "Devanagari"), ("telugu", "Telugu"), ("kannada", "Kannada"), ("tamil", "Tamil"), ("arabic", "Arabic"))


def script(text: Column) -> Column:
    """The script of most letters; other scripts count as latin, "empty" without letters. Ties: latin, then as listed."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    counts = [F.length(letters) - F.length(F.regexp_replace(letters, rf"\p{{Is{name}}}", "")) for _, name in SCRIPTS]
    latin = F.length(letters) - sum(counts[1:], counts[0])
    most = F.greatest(latin, *counts)
    out = F.when(latin == most, F.lit("latin"))
    for (label, _), n in zip(SCRIPTS, counts, strict=True):
        out = out.when(n == most, F.lit(label))
    return F.when(letters == "", F.lit("empty")).otherwise(out)


def has_indic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[ऀ-ൿ]")


def has_non_ascii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]")
