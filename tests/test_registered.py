from types import SimpleNamespace

from kinlink.operators import model
from kinlink.plans import config, pipeline, queries_links, registry
from kinlink.sources.records import records


def test_features_of_every_candidate(spark, sf):
    for preset in (config.LGBM_V1, config.RESCORE):
        own = pipeline.normal_records(records(spark, sf), preset)
        want = {(r.s1, r.cid) for r in pipeline.candidates(own, preset).select("s1", "cid").collect()}
        got = registry.QUERIES[f"features_{len(preset.features)}_{preset.name}"](spark, sf).select("s1", "cid").collect()
        assert len(got) == len(want) and {(r.s1, r.cid) for r in got} == want


def test_examples_and_calibration_of_every_candidate(spark, sf):
    own = pipeline.normal_records(records(spark, sf), config.THREE_CHANNEL)
    assert queries_links.examples(spark, sf).count() == pipeline.candidates(own, config.THREE_CHANNEL).count()
    for name in ("ml9_platt", "ml9_isotonic"):
        assert registry.QUERIES[name](spark, sf).count() == queries_links.scored(spark, sf).count()


def test_model_queries_use_the_presets_own_settings(spark, sf, monkeypatch):
    seen = []
    tree = SimpleNamespace(stages=[SimpleNamespace(getNumTrees=7)])
    monkeypatch.setattr(model, "fit", lambda rows, features, **options: seen.append(options) or tree)
    monkeypatch.setattr(model, "predict", lambda fitted, rows: rows.selectExpr("*", "0.5D AS prob"))
    resolved = []
    real = pipeline.resolve
    monkeypatch.setattr(pipeline, "resolve", lambda own, preset, fitted, **options: resolved.append((preset.name, options)) or real(own, config.SPRINT1))
    registry.QUERIES["resolve_lgbm_v1"](spark, sf)
    # the first fit stops early, the second takes its number of trees; all else are the operator's own settings
    assert list(seen[0]) == ["held"] and seen[1:] == [{"trees": 7}] and resolved == [("lgbm_v1", {})]
    folds = {r.fold for r in registry.QUERIES["ml5_boosted_trees"](spark, sf).select("fold").distinct().collect()}
    assert seen[2:] == [{}] * 3 and folds <= {0, 1, 2} and len(folds) == 3


def test_positives_alone_still_weigh(spark):
    only = spark.createDataFrame([(1.0,), (1.0,)], "label double")
    assert {r.weight for r in model.class_weight(only).collect()} == {1.0}
