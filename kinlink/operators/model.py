"""Training and scoring of the boosted-tree reranker, with folds by query."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import write_table


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where they are true links."""
    t = truth.select("s1", "cid").distinct().withColumn("label", F.lit(1.0))
    return pairs.join(t, ["s1", "cid"], "left").na.fill(0.0, ["label"])


def fold(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """All pairs of a query fall in one fold."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def row_fold(*key: str, folds: int = 5) -> Column:
    """Pairs fall in folds by themselves: by the leading hex digits of a digest of their keys."""
    digest = F.md5(F.concat_ws("|", *key).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def hard_negatives(pairs: DataFrame, truth: DataFrame, most: int = 35) -> DataFrame:
    """Candidates up to a rank, and missed true links at rank 1, with their label."""
    near = label(pairs.where(F.col("rank") <= most).select("s1", "cid", "rank"), truth)
    missed = truth.select("s1", "cid").distinct().join(near.select("s1", "cid"), ["s1", "cid"], "left_anti")
    return near.unionByName(missed.select("s1", "cid", F.lit(1).alias("rank"), F.lit(1.0).alias("label")))


def sampled_negatives(records: DataFrame, truth: DataFrame, each: int, seed: int = 42) -> DataFrame:
    """For each query ``each`` pseudo-random corpus records of its country that are no true link.

    Corpus records are numbered within their country in hash order, and queries draw numbers,
    so the pairs come from an equi-join. The numbers run within ranges of hashes, each starting
    where the lower ranges of its country end.
    """
    corpus = records.where("side <> 'S1'").select("country", F.col("doc").alias("cid"), F.xxhash64(F.lit(seed), "doc").alias("_h"))
    corpus = corpus.withColumn("_part", F.shiftright("_h", 54))  # 1,024 ranges
    before = Window.partitionBy("country").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = corpus.groupBy("country", "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = starts.groupBy("country").agg((F.sum("_n") - 1).alias("top"))
    starts = starts.select(F.col("country").alias("_c"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("country", "_part").orderBy("_h", "cid")
    corpus = corpus.withColumn("_k", F.row_number().over(order) - 1)
    corpus = corpus.join(starts, F.col("country").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).select("country", "cid", (F.col("_start") + F.col("_k")).alias("k"))
    queries = records.where("side = 'S1'").select("country", F.col("doc").alias("s1")).join(F.broadcast(sizes), "country")
    draws = queries.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "s1", "d"), F.col("top") + 1))
    pairs = draws.join(corpus, ["country", "k"]).select("s1", "cid").distinct()
    return pairs.join(truth.select("s1", "cid"), ["s1", "cid"], "left_anti")


def class_weight(rows: DataFrame, factor: float = 1.0) -> DataFrame:
    """Positives weigh as much as negatives together, times a factor; without negatives all weigh 1."""
    counts = rows.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p = counts.p or 0.0
    heavy = factor * (counts.n - p) / max(p, 1.0) if counts.n > p else 1.0
    return rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(heavy))).otherwise(F.lit(1.0)))


def classes(rows: DataFrame, features: tuple[str, ...], *keys: str) -> DataFrame:
    """Equal examples as one row with the number of its ``copies``, as a table; ``keys`` stay beside features, label and weight.

    A tree sees nothing else of an example, so a row may weigh as much as all its copies. Candidates for splits come
    from Spark's sample of at least 10,000 rows, by weight: of classes instead of examples.
    """
    own = rows.groupBy(*features, "label", "weight", *keys).agg(F.count(F.lit(1)).alias("copies"))
    return write_table(own, "classes")


def fit(rows: DataFrame, features: tuple[str, ...], trees: int = 30, depth: int = 5, rate: float = 0.1, held: Column | None = None, seed: int = 42) -> PipelineModel:
    """Boosted trees on (features, label, weight), or classes() of them; with ``held`` rows, training stops where they no longer gain."""
    if held is not None:
        rows = rows.withColumn("held", held)
    if "copies" not in rows.columns:
        rows = classes(rows, features, *(["held"] if held is not None else []))
    rows = rows.withColumn("weight", F.col("weight") * F.col("copies"))
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=64)
    if held is not None:
        gbt = gbt.setValidationIndicatorCol("held")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("prob", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction", "held")


def fit_two_pass(rows: DataFrame, features: tuple[str, ...], hard: float = 0.1, weight: float = 3.0, **options) -> PipelineModel:
    """A second fit in which negatives that the first one scored above ``hard`` weigh more."""
    rows = rows if "copies" in rows.columns else classes(rows, features)
    return fit(harder(rows, fit(rows, features, **options), hard, weight), features, **options)


def harder(rows: DataFrame, first: PipelineModel, hard: float = 0.1, weight: float = 3.0) -> DataFrame:
    """Rows whose negatives weigh more where a first model scored them above ``hard``."""
    heavy = (F.col("label") == 0) & (F.col("prob") > hard)
    return predict(first, rows).withColumn("weight", F.when(heavy, F.lit(weight)).otherwise(F.col("weight"))).drop("prob")


def cross_validated(rows: DataFrame, features: tuple[str, ...], folds: int = 3, two_pass: bool = False, **options) -> DataFrame:
    """Out-of-fold prob of each row; a query's pairs are never on both sides."""
    rows = rows.withColumn("fold", fold(F.col("s1"), folds))
    known = classes(rows, features, "fold")

    @inheritable_thread_target(rows.sparkSession)
    def fitted(k: int) -> PipelineModel:
        return (fit_two_pass if two_pass else fit)(known.where(F.col("fold") != k), features, **options)

    # a fit is many short jobs, so those of the folds go side by side
    with ThreadPoolExecutor(folds) as pool:
        models = list(pool.map(fitted, range(folds)))
    out = None
    for k, model in enumerate(models):
        part = predict(model, rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def fit_early(rows: DataFrame, features: tuple[str, ...], folds: int = 5, **options) -> tuple[PipelineModel, int]:
    """A model that stopped where one fold's queries no longer gained, and how many trees it has."""
    made = fit(rows, features, held=fold(F.col("s1"), folds) == 0, **options)
    return made, made.stages[-1].getNumTrees


def refit(rows: DataFrame, features: tuple[str, ...], folds: int = 3, **options) -> tuple[PipelineModel, PipelineModel]:
    """``(final, best)``: a fit on all rows with the mean number of trees of the folds' early stops, and the best fold's model.

    The best fold is that of the greatest F0.5 over its own queries' pairs at prob 0.5.
    """
    trees, best = [], None
    rows = rows.withColumn("fold", fold(F.col("s1"), folds))
    for k in range(folds):
        made = fit(rows.drop("fold"), features, held=fold(F.col("s1"), folds) == k, **options)
        trees.append(made.stages[-1].getNumTrees)
        own = fold_summary(predict(made, rows.where(F.col("fold") == k)), 0.5).first()
        score = (own.f05 or 0.0) if own is not None else 0.0
        if best is None or score > best[0]:
            best = (score, made)
    final = fit(rows.drop("fold"), features, **(options | {"trees": max(1, round(sum(trees) / len(trees)))}))
    return final, best[1]


def importance(model: PipelineModel, features: tuple[str, ...]) -> list[tuple[str, float]]:
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))


def platt(scored: DataFrame) -> DataFrame:
    """prob calibrated by a logistic curve over its log-odds."""
    p = F.least(F.greatest("prob", F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = scored.withColumn("_z", F.log(p / (1 - p)))
    rows = VectorAssembler(inputCols=["_z"], outputCol="_f").transform(rows)
    model = LogisticRegression(featuresCol="_f", labelCol="label", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(rows)
    return model.transform(rows).withColumn("calibrated", vector_to_array("_p")[1]).drop("_z", "_f", "_p", "_r", "_y")


def isotonic(scored: DataFrame) -> DataFrame:
    """prob calibrated by a rising step curve."""
    rows = VectorAssembler(inputCols=["prob"], outputCol="_f").transform(scored)
    model = IsotonicRegression(featuresCol="_f", labelCol="label", predictionCol="calibrated").fit(rows)
    return model.transform(rows).drop("_f")


def country_taus(sweeps: dict[str, list[tuple[float, float]]], unlabelled: dict[str, str], lift: float = 0.03, most: float = 0.95) -> dict[str, float]:
    """The best threshold of each country; one without labels takes another's, raised."""
    best = {c: max(rows, key=lambda r: (r[1], -r[0]))[0] for c, rows in sweeps.items() if rows}
    return best | {c: min(most, best[like] + lift) for c, like in unlabelled.items() if like in best}


def fold_summary(scored: DataFrame, tau: float) -> DataFrame:
    """Precision, recall and F0.5 over pairs of each fold."""
    hit = F.col("prob") >= tau
    per = scored.groupBy("fold").agg(
        F.sum(hit.cast("double")).alias("p"), F.sum("label").alias("t"), F.sum(F.when(hit, F.col("label")).otherwise(0.0)).alias("tp")
    )
    precision, recall = F.col("tp") / F.nullif(F.col("p"), F.lit(0.0)), F.col("tp") / F.nullif(F.col("t"), F.lit(0.0))
    return per.select("fold", precision.alias("precision"), recall.alias("recall"), (1.25 * precision * recall / F.nullif(0.25 * precision + recall, F.lit(0.0))).alias("f05"))
