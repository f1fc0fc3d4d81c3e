"""Presets: each generation of the resolver is one set of parameters of the same operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions import fixed
from ..operators.vectorize import Vectorizer

#: Ordinals up to which S1 and corpus records take part in fitting vocabularies.
SAMPLE = (100_000, 400_000)


@dataclass(frozen=True)
class Channel:
    """One candidate channel. ``field`` is name, address or both (the name twice and the address)."""

    kind: str  # term, char, set, spaceless, postal, phonetic, prefix, premise, house, prefix4
    slot: str
    field: str = "both"
    vectorizer: Vectorizer | None = None
    k: int = 30
    grams: tuple[int, int] = (3, 5)
    most: int | None = None


@dataclass(frozen=True)
class Preset:
    name: str
    normal: str  # basic, suffix, rules, v1, v2, v3
    channels: tuple[Channel, ...]
    cap: int = 50
    score: str = "max"  # max, blend, rules, model
    blend: tuple[float, float] = (0.55, 0.45)
    features: tuple[str, ...] = ()
    tau: float | dict[str, float] = 0.8
    assign: str = "uncapped"  # none, uncapped, capped, by_source
    capacity: dict[str, int] = field(default_factory=dict)
    tau_singleton: float | None = None
    chain_guard: bool = False
    neighbours: int = 0
    guards: bool = False
    strict: bool = False


def word(slot: str, field_: str, df: float, k: int, features: int = 150_000, small: int = 1000) -> Channel:
    return Channel("term", slot, field_, Vectorizer(2, df, features, small), k)


def char(slot: str, df: float, k: int, grams: tuple[int, int], features: int = 80_000, least: int = 2) -> Channel:
    return Channel("char", slot, "name", Vectorizer(least, df, features, 1000), k, grams)


def overlap(slot: str, df: float, k: int, features: int = 80_000) -> Channel:
    return Channel("set", slot, "address", Vectorizer(2, df, features, 1000, binary=True), k)


def index(kind: str, slot: str, most: int | None) -> Channel:
    return Channel(kind, slot, most=most)


SPRINT0 = Preset("sprint0", "suffix", (char("word", 0.05, 30, (3, 5)),), 30, tau=0.5, assign="none")
SPRINT0V2 = Preset("sprint0v2", "suffix", (word("word", "name", 0.05, 30), word("addr", "address", 0.05, 30)), 30, "blend", tau=0.5, assign="none")
SPRINT1 = Preset("sprint1", "basic", (word("word", "both", 0.01, 35),), 35, tau=0.6, assign="none")
BASELINE = Preset("baseline", "basic", (word("word", "both", 0.01, 30), overlap("addr", 0.02, 30, 100_000)), 50, tau=0.8)
LGBM_V1 = replace(BASELINE, name="lgbm_v1", score="model", features=fixed.FEATURES_18, tau=0.67)
THREE_CHANNEL = Preset(
    "three_channel", "basic", (word("word", "both", 0.01, 30, 100_000), overlap("addr", 0.02, 30, 70_000), char("char", 0.05, 30, (3, 5), least=3)), 50,
    "model", features=fixed.FEATURES_16, tau={"US": 0.55, "India": 0.55, "France": 0.60},
)
RULES = Preset(
    "rules", "rules", (word("word", "both", 0.05, 35, 60_000), index("premise", "premise", 10)), 40, "rules",
    tau={"US": 0.60, "India": 0.65, "France": 0.65}, assign="capped", capacity={"US": 7, "India": 8, "France": 6},
)
V1 = Preset(
    "v1", "v1", (word("word", "both", 0.02, 40, 120_000), overlap("addr", 0.03, 40), char("char", 0.01, 40, (3, 4), 50_000, 5), word("sorted", "name", 0.05, 25, 60_000), index("postal", "postal", 500)), 80,
    "model", features=fixed.FEATURES_32, tau=0.7,
)
V2 = Preset(
    "v2", "v2", (word("word", "both", 0.03, 40, 120_000), overlap("addr", 0.04, 40), char("char", 0.01, 40, (3, 4), 50_000, 5), word("sorted", "name", 0.04, 25, 60_000), index("spaceless", "spaceless", 50), index("postal", "postal", 1000)), 80,
    "model", features=fixed.FEATURES_35, tau=0.64,
)
V3 = Preset(
    "v3", "v3",
    (word("word", "both", 0.03, 50), overlap("addr", 0.04, 50), char("char", 0.01, 50, (2, 5)), word("sorted", "name", 0.04, 50, 60_000),
     index("spaceless", "spaceless", 200), index("postal", "postal", 2000), index("phonetic", "phonetic", 500), index("prefix", "prefix", 300)),
    100, "model", features=fixed.FEATURES_50, tau=0.7, assign="by_source", capacity={"S2": 5, "S3": 6},
)
V4 = replace(V3, name="v4", cap=40, neighbours=10, features=fixed.FEATURES_51, tau={"US": 0.910, "India": 0.825, "France": 0.940}, tau_singleton=0.848, chain_guard=True)
RESCORE = Preset("rescore", "basic", BASELINE.channels, 35, "model", features=fixed.FEATURES_RESCORE, tau=0.7, guards=True)
HARDENED = replace(BASELINE, name="hardened", guards=True)

PRESETS = {p.name: p for p in (SPRINT0, SPRINT0V2, SPRINT1, BASELINE, LGBM_V1, THREE_CHANNEL, RULES, V1, V2, V3, V4, RESCORE, HARDENED)}
