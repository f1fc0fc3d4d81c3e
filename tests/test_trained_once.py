from kinlink.plans import config, pipeline
from kinlink.sources.records import records, truth


def test_classes_and_features_are_made_once(spark, sf, monkeypatch):
    own = records(spark, sf).cache()
    made = []
    for module in (pipeline, pipeline.model):
        real = module.write_table
        monkeypatch.setattr(module, "write_table", lambda df, tag, real=real: made.append(tag) or real(df, tag))
    fitted = pipeline.train(own, truth(own), config.LGBM_V1, trees=2)
    again = pipeline.resolve(own, config.LGBM_V1, fitted, tau=0.0)
    assert made.count("classes") == 1 and made.count("train") == 1 and made.count("normal") == 1
    other = pipeline.resolve(records(spark, sf), config.LGBM_V1, fitted, tau=0.0)
    assert made.count("normal") == 2 and sorted(map(tuple, again.collect())) == sorted(map(tuple, other.collect()))
