"""Resolution from records to links: one lazy plan for each preset.

records -> normal forms -> channels -> union -> features -> scores -> claims -> assignment
-> guards. Records are (entity_id, src, name, address, country); links come as
(s1, cid, prob, ord), ord being the place in the query's list.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sm
from ..functions import text as tx
from ..operators import assign, blocking, decide, features, guards, knn, metrics, model
from ..operators import vectorize as vz
from ..operators.tables import discard, scratch, write_table
from . import normalize
from .config import Channel, Preset


def normal_records(records: DataFrame, preset: Preset) -> DataFrame:
    """Normal forms of a preset, always with doc, side, country, name_norm and addr_norm."""
    if preset.normal == "basic":
        return normalize.basic(records)
    if preset.normal == "rules":
        rows = normalize.rule_records(records)
        # addresses are compared as their tokens
        return rows.withColumn("name_norm", F.col("name_clean")).withColumn("addr_norm", F.array_join("tokens", " "))
    if preset.normal == "suffix":
        rows = normalize.basic(records)
        return rows.withColumn("name_norm", tx.NAME_SUFFIXES.col("name_raw")).withColumn("addr_norm", tx.ADDRESS.col("addr_raw"))
    rows = normalize.normalized(records, int(preset.normal[1:]), preset.strict)
    return rows.withColumn("name_vector", knn.hashed_embedding(F.col("name_norm"))) if preset.neighbours else rows


def _text(channel: Channel) -> Column:
    name, addr = F.col("name_norm"), F.col("addr_norm")
    return {"name": name, "address": addr, "both": tx.composite(name, addr)}[channel.field]


def channel_pairs(rows: DataFrame, channel: Channel) -> DataFrame:
    if channel.kind in ("term", "char", "set"):
        terms = partial(vz.char_terms, low=channel.grams[0], high=channel.grams[1]) if channel.kind == "char" else vz.word_terms
        return blocking.term_channel(rows, _text(channel), channel.vectorizer, channel.k, terms=terms)
    own = {
        "spaceless": blocking.spaceless_channel, "postal": blocking.postal_channel, "phonetic": blocking.phonetic_channel,
        "prefix": blocking.prefix_channel, "premise": blocking.premise_channel,
    }
    if channel.kind in own:
        return own[channel.kind](rows, channel.most)
    return blocking.key_channel(rows, F.col("hn") if channel.kind == "house" else tx.prefix_key(F.col("name_clean"), 4), channel.most)


def candidates(rows: DataFrame, preset: Preset) -> DataFrame:
    """``(s1, cid, s_*, score, rank)`` of a preset's channels.

    Each channel is a table before they are united, so the disk never holds the shuffles of several channels together.
    """
    made = {c.slot: write_table(channel_pairs(rows, c), "channel") for c in preset.channels}
    if {"spaceless", "postal", "phonetic", "prefix"} & set(made):
        pairs = blocking.ordered_union(made, preset.cap)
    else:
        pairs = blocking.simple_union(made, preset.cap)
    if preset.neighbours:
        near = neighbours(rows.select("country", "doc", "side", F.col("name_vector").alias("v")), preset.neighbours)
        pairs = blocking.with_neighbours(pairs, near, 50)
        scores = [c for c in pairs.columns if c.startswith("s_")]
        pairs = pairs.withColumn("score", F.greatest(*scores))
    return pairs


def candidate_table(rows: DataFrame, preset: Preset) -> DataFrame:
    """candidates() as a table; those on its way are deleted."""
    with scratch() as way:
        made = write_table(candidates(rows, preset), "pairs")
        way.remove(made)
    return made


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest corpus records by vector, within a country, as (s1, cid, score, rank).

    Exact: blocks of a country's queries meet blocks of its corpus records.
    """
    queries = rows.where("side = 'S1'").select("country", F.col("doc").alias("s1"), "v")
    return knn.exact(queries, rows.where("side <> 'S1'").select("country", F.col("doc").alias("cid"), "v"), k, "country")


def feature_rows(pairs: DataFrame, rows: DataFrame, preset: Preset) -> DataFrame:
    """s1, cid, country, the label if pairs have one, and the preset's features."""
    if len(preset.features) == 16:
        return features.features_16(features.paired(pairs, features.records_16(rows), features.SETS_16))
    if len(preset.features) == 18:
        return features.features_18(features.paired(pairs, features.records_18(rows), features.SETS_18, ("deep", "addr_norm")))
    if preset.name == "rescore":
        return features.rescore_35(features.rescore_pairs(pairs, rows))
    raw = preset.normal == "v1"
    read = preset.features, "name_raw" if raw else "name_norm", "addr_raw" if raw else "addr_norm"
    return features.dense(pairs, rows, *read)


def scored(rows: DataFrame, preset: Preset, trained: PipelineModel | None = None) -> DataFrame:
    """``(s1, cid, country, prob)`` of all candidates."""
    pairs = candidates(rows, preset)
    if preset.score == "rules":
        return decide.rules(features.paired(pairs.select("s1", "cid", "s_word"), rows.select("doc", "side", *decide.RULES_READ), decide.RULES_SETS, ("name_clean", "addr_raw")))
    if preset.score == "model":
        if trained is None:
            raise ValueError(f"preset {preset.name} needs a model")
        return model.predict(trained, feature_rows(pairs, rows, preset)).select("s1", "cid", "country", "prob")
    if preset.score == "blend":
        pairs = pairs.withColumn("score", preset.blend[0] * F.col("s_word") + preset.blend[1] * F.col("s_addr"))
    return pairs.join(rows.select(F.col("doc").alias("s1"), "country"), "s1").select("s1", "cid", "country", F.col("score").alias("prob"))


#: True links weigh this much of what would make them weigh as much as the others together.
POSITIVE_WEIGHT = 0.7


def examples(records: DataFrame, truth: DataFrame, preset: Preset) -> tuple[DataFrame, DataFrame]:
    """Normal forms, and labelled features of the preset's own candidates, as tables.

    The records keep them: a resolve() of the same records by the same preset makes neither again.
    """
    rows = write_table(normal_records(records, preset), "normal")
    pairs = candidate_table(rows, preset)
    made = write_table(feature_rows(model.label(pairs, truth), rows, preset), "train")
    records._examples = (preset, rows, made)
    return rows, made


def train(records: DataFrame, truth: DataFrame, preset: Preset, **options) -> PipelineModel:
    """The preset's model, fitted on its own candidates of labelled records.

    A first fit stops where a held-out fifth of the queries no longer gains; the second has as many trees, all
    queries, and heavier hard negatives. Both read one table of classes.
    """
    rows = model.class_weight(examples(records, truth, preset)[1], POSITIVE_WEIGHT)
    known = model.classes(rows.withColumn("held", model.fold(F.col("s1")) == 0), preset.features, "held")
    first = model.fit(known, preset.features, held=F.col("held"), **options)
    trained = model.fit(model.harder(known, first), preset.features, **(options | {"trees": first.stages[-1].getNumTrees}))
    discard(known)
    return trained


def thresholds(records: DataFrame, truth: DataFrame, preset: Preset, trained: PipelineModel, unlabelled: dict[str, str] | None = None) -> dict[str, float]:
    """Each country's best tau by macro F0.5: a coarse sweep, then a fine one around its best.

    A country without labels takes that of the one it is likened to, raised.
    """
    rows = write_table(normal_records(records, preset), "normal")
    pairs = write_table(scored(rows, preset, trained), "scored")
    queries = records.where("src = 'S1'").select(F.col("entity_id").alias("s1"), "country")
    sweeps = {}
    for r in queries.select("country").distinct().orderBy("country").collect():
        here = F.col("country") == r.country
        if r.country in (unlabelled or {}):
            continue
        own = queries.where(here).select("s1")
        links = pairs.where(here)
        known = truth.join(own, "s1", "left_semi")
        got = [(x.tau, x.f05) for x in metrics.sweep(own, known, links, [k / 20 for k in range(1, 20)]).collect()]
        top = max(got, key=lambda x: (x[1], -x[0]))[0]
        fine = [round(top + k / 200, 3) for k in range(-8, 9) if k and 0 < top + k / 200 < 1]
        sweeps[r.country] = got + [(x.tau, x.f05) for x in metrics.sweep(own, known, links, fine).collect()]
    return model.country_taus(sweeps, unlabelled or {})


def assigned(claims: DataFrame, preset: Preset) -> DataFrame:
    if preset.assign == "none":
        return claims
    if preset.assign == "uncapped":
        return assign.uncapped(claims)
    if preset.assign == "capped":
        most = F.lit(max(preset.capacity.values()))
        for country, n in preset.capacity.items():
            most = F.when(F.col("country") == country, F.lit(n)).otherwise(most)
        return assign.capped(claims, most)
    return assign.capped_by_source(claims.withColumn("is_s3", F.col("cid").startswith("S3-").cast("int")), preset.capacity["S2"], preset.capacity["S3"])


def resolve(records: DataFrame, preset: Preset, trained: PipelineModel | None = None, tau: float | dict | None = None) -> DataFrame:
    """``(s1, cid, prob, ord)``: the links of a preset.

    Normal forms are read by every channel and by the features, and scores by every guard and
    round, so both are tables in the shared folder: neither is computed twice. Records that were
    trained on by this preset have their examples() already.
    """
    kept, rows, made = getattr(records, "_examples", (None, None, None))
    if kept != preset:
        rows, made = write_table(normal_records(records, preset), "normal"), None
    every = scored(rows, preset, trained) if made is None else model.predict(trained, made).select("s1", "cid", "country", "prob")
    pairs = write_table(every, "scored")
    if preset.chain_guard:
        names = guards.chain_names(rows)
        clean = features.paired(pairs.select("s1", "cid", "prob", F.col("country").alias("_c")), rows.select("doc", "side", "name_clean", "addr_norm"))
        clean = clean.withColumn("addr_token_set", sm.string_similarities(F.col("a_addr_norm"), F.col("b_addr_norm"), ("token_set_ratio",)).token_set_ratio)
        pairs = guards.chain_zero(clean, names).select("s1", "cid", F.col("_c").alias("country"), "prob")
    pairs = pairs.withColumn("prob", F.round("prob", 6))
    claims = decide.above(pairs, preset.tau if tau is None else tau)
    if preset.tau_singleton is not None:
        claims = guards.weak_queries(claims, pairs, preset.tau_singleton)
    links = assigned(claims, preset).select("s1", "cid", "prob")
    order = Window.partitionBy("s1").orderBy(F.desc("prob"), "cid")
    links = links.withColumn("ord", F.row_number().over(order))
    if preset.guards:
        kept = guards.harden(links, normalize.hardening(records)).where("reason IS NULL")
        links = kept.select("s1", "cid", "prob", "ord")
    return links
