"""Spatially blocked classifier benchmark on MLlib: search, fit, probabilities, controls and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.functions import keyed
from siterank.operators import metrics
from siterank.operators.lineage import materialise
from siterank.operators.order import with_ranks

# Row bands of blocks used for inner validation, with one excluded row on either side.
VALIDATION_BANDS = [(0, 2), (3, 6), (7, 9)]


def families(features: Sequence[str], classes: int, seed: int = keyed.SEED) -> dict[str, Callable[..., Estimator]]:
    """The model families; each entry builds a pipeline from its grid parameters."""
    def scaled(*stages) -> Pipeline:
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"),
                                StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), *stages])

    common = dict(labelCol="y", featuresCol="features")
    return {
        "logistic": lambda regularisation=0.1: scaled(LogisticRegression(**common, weightCol="weight", family="multinomial", regParam=regularisation, maxIter=100)),
        "forest": lambda min_leaf=1, depth=10, trees=100: scaled(RandomForestClassifier(
            **common, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)),
        "perceptron": lambda hidden=(64, 32), iterations=100: scaled(MultilayerPerceptronClassifier(
            **common, layers=[len(features), *hidden, classes], maxIter=iterations, seed=seed)),
        "boosted": lambda depth=4, rounds=20: scaled(OneVsRest(
            classifier=GBTClassifier(maxDepth=depth, maxIter=rounds, seed=seed), **common)),
    }


def balanced(df: DataFrame) -> DataFrame:
    """Class-balance weights from the class totals."""
    totals = df.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    sizes = totals.agg(F.struct(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")))
    return df.join(totals, "y").withColumn("_t", sizes.scalar()).withColumn("weight", F.col("_t.rows") / (F.col("_t.classes") * F.col("_n"))).drop("_n", "_t")


def probabilities(model: PipelineModel, df: DataFrame, classes: int, name: str) -> DataFrame:
    """Predictions in the metric layout; a class the model never saw gets probability 0."""
    out = model.transform(df)
    p = vector_to_array("probability") if "probability" in out.columns else F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (F.col("prediction") == k).cast("double"))
    padded = F.slice(F.concat(p, F.array_repeat(F.lit(0.0), classes)), 1, classes)
    return out.select(F.lit(name).alias("model"), "id", "block", "y", padded.alias("p"))


def inner_fold(block: Column, low: int, high: int) -> tuple[Column, Column]:
    """(training, validation) rows of one band; the rows next to the band train nothing."""
    row = F.floor(block / 10)
    return (row < low - 1) | (row > high + 1), row.between(low, high)


def search(development: DataFrame, build: Callable[..., Estimator], grid: Sequence[dict], classes: int,
           bands: Sequence[tuple[int, int]] = tuple(VALIDATION_BANDS)) -> tuple[dict, float]:
    """L4: the parameters with the largest mean macro-F1 over buffered validation bands (development rows only)."""
    best: tuple[float, dict] | None = None
    for parameters in grid:
        scores = []
        for low, high in bands:
            train, check = inner_fold(F.col("block"), low, high)
            model = build(**parameters).fit(balanced(development.where(train)))
            predicted = metrics.with_prediction(probabilities(model, development.where(check), classes, "m"))
            scores.append(metrics.summary(metrics.confusion(predicted), classes).first()["macro_f1"])
        mean = sum(scores) / len(scores)
        if best is None or mean > best[0]:
            best = (mean, parameters)
    return best[1], best[0]


def class_prior(development: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """The class shares of the development rows as constant probabilities."""
    shares = development.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    lookup = shares.agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), F.col("n").cast("double"))))).scalar()
    total = F.aggregate(F.map_values("_m"), F.lit(0.0), lambda s, v: s + v)
    p = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)) / F.col("_t"))
    return test.withColumn("_m", lookup).withColumn("_t", total).select(F.lit("class-prior").alias("model"), "id", "block", "y", p.alias("p"))


def shuffled(df: DataFrame, column: str, stream: str, seed: int = keyed.SEED) -> DataFrame:
    """A column dealt out anew: rows are numbered by id, and each takes the value at the keyed permutation of its number."""
    numbered = with_ranks(df.select("id", column), [], "id", "_i", "ordinal", descending=False, tie="id").withColumn("_i", (F.col("_i") - 1).cast("bigint"))
    size = df.agg(F.count(F.lit(1)).alias("n"))
    targets = numbered.withColumn("_n", size.scalar()).select("id", keyed.permuted(F.col("_i"), F.col("_n"), stream, seed).alias("_i"))
    dealt = targets.join(numbered.select("_i", F.col(column)), "_i").select("id", column)
    return df.drop(column).join(dealt, "id").select(*df.columns)


def out_of_fold(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Predictions of every row by a model fitted on the other folds only, gathered into one written table."""
    parts = []
    for k in range(folds):
        model = fit(df.where(F.col(fold) != k))
        parts.append(predict(model, df.where(F.col(fold) == k)))
    return materialise(reduce(DataFrame.unionByName, parts))


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], classes: int, repeats: int = 20) -> DataFrame:
    """Mean and deviation of the macro-F1 drop when one feature is dealt out anew."""
    base = metrics.summary(metrics.confusion(metrics.with_prediction(probabilities(model, test, classes, "base"))), classes).select("macro_f1")
    parts = []
    for feature in features:
        for repeat in range(repeats):
            mixed = shuffled(test, feature, f"{feature}:{repeat}")
            parts.append(probabilities(model, mixed, classes, f"{feature}|{repeat}"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    scores = metrics.summary(metrics.confusion(metrics.with_prediction(stacked)), classes)
    drop = base.scalar() - F.col("macro_f1")
    return scores.withColumn("drop", drop).groupBy(F.split_part("model", F.lit("|"), F.lit(1)).alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_sd"))


def impurity_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Impurity importances of a fitted forest."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def class_distribution(df: DataFrame, role: str, label: str) -> DataFrame:
    """Samples per class and role, absent pairs as 0."""
    out = df.groupBy(label).pivot(role, ["development", "buffer", "test"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


def feature_screen(df: DataFrame, features: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Missing values, variance, distinct values and the retained rule per feature, from one long aggregation."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("o")).select("o.*")
    values = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    mean = values.groupBy("feature").agg((F.sum(F.col("n") * F.col("v")) / n).alias("_m"))
    joined = values.join(mean, "feature")
    out = joined.groupBy("feature").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.try_divide(F.sum(F.col("n") * (F.col("v") - F.col("_m")) * (F.col("v") - F.col("_m"))), n - 1).alias("variance"),
        F.count("v").alias("unique_values"))
    return out.withColumns({"retained": (F.col("missing_count") == 0) & F.coalesce(F.col("variance") > 0, F.lit(False)),
                            "scientific_role": F.when(F.col("feature").isin(*bands), "reflectance band").otherwise("engineered spectral index")})
