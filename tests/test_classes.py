import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kinlink.operators import model

NAMES = ("x", "y")


@pytest.fixture(scope="module")
def rows(spark):
    def digit(seed, n):
        return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))

    made = spark.range(3000).select(F.concat(F.lit("q"), F.col("id") % 300).alias("s1"), F.col("id").alias("cid"), (digit(1, 7) / 7).alias("x"), (digit(2, 5) / 5).alias("y"), digit(3, 10).alias("noise"))
    made = made.withColumn("label", ((F.col("x") + F.col("y") > 0.9) != (F.col("noise") == 0)).cast("double"))
    return model.class_weight(made.drop("noise")).cache()


def test_equal_examples_train_as_one(rows):
    known = model.classes(rows, NAMES)
    assert known.count() == rows.select(*NAMES, "label").distinct().count() < 100 and known.agg(F.sum("copies")).first()[0] == 3000
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=8, maxDepth=5, stepSize=0.1, seed=42, maxBins=64)
    plain = Pipeline(stages=[VectorAssembler(inputCols=list(NAMES), outputCol="features"), gbt]).fit(rows)
    want = {(r.x, r.y): r.prob for r in model.predict(plain, rows).select("x", "y", "prob").distinct().collect()}
    for given in (rows, known):
        got = {(r.x, r.y): r.prob for r in model.predict(model.fit(given, NAMES, trees=8), rows).select("x", "y", "prob").distinct().collect()}
        assert got == {k: pytest.approx(p, abs=1e-9) for k, p in want.items()}


@pytest.mark.parametrize("two_pass", [False, True])
def test_folds_side_by_side_as_one_by_one(rows, two_pass):
    got = model.cross_validated(rows, NAMES, two_pass=two_pass, trees=4)
    assert got.count() == 3000 and "copies" not in got.columns
    own = rows.withColumn("fold", model.fold(F.col("s1"), 3))
    for k in range(3):
        alone = (model.fit_two_pass if two_pass else model.fit)(own.where(F.col("fold") != k).drop("fold"), NAMES, trees=4)
        want = {r.cid: r.prob for r in model.predict(alone, own.where(F.col("fold") == k)).collect()}
        assert {r.cid: r.prob for r in got.where(F.col("fold") == k).collect()} == {c: pytest.approx(p, abs=1e-9) for c, p in want.items()}
