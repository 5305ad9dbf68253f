"""Classification metrics, calibration and block-resampled intervals from a prediction table.

Predictions are (model, id, block, y, p) with ``y`` a class index and ``p`` the class probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions import keyed
from siterank.operators.lineage import materialise
from siterank.operators.order import numbered, value_positions


def with_prediction(predictions: DataFrame) -> DataFrame:
    """Top label (lowest class on ties), its probability and the normalised entropy."""
    top = F.array_max("p")
    terms = F.aggregate("p", F.lit(0.0), lambda s, q: s + F.when(q > 0, q * F.log(q)).otherwise(0.0))
    return predictions.withColumns({
        "confidence": top, "prediction": (F.array_position("p", top) - 1).cast("int"),
        "entropy": -terms / F.log(F.size("p").cast("double"))})


def confusion(predicted: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts per (keys, y, prediction)."""
    return predicted.groupBy(*keys, "y", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_table(predicted: DataFrame, classes: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The matrix with one row per true class and one column per predicted class."""
    out = predicted.groupBy(*keys, "y").pivot("prediction", list(range(classes))).agg(F.count(F.lit(1)))
    return out.select(*keys, "y", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"predicted_{k}") for k in range(classes)])


def _label_counts(counts: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Support, predictions and hits of every label that occurs."""
    roles = F.array(F.struct(F.col("y").cast("int").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")),
                    F.struct(F.col("prediction").cast("int").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q")))
    sided = counts.select(*keys, F.col(amount).alias("_n"), (F.col("y") == F.col("prediction")).alias("_hit"), F.explode(roles).alias("r"))
    return sided.groupBy(*keys, F.col("r.label").alias("label")).agg(
        F.sum(F.col("_n") * F.col("r.t")).alias("support"), F.sum(F.col("_n") * F.col("r.q")).alias("predicted"),
        F.sum(F.when(F.col("_hit"), F.col("_n") * F.col("r.t")).otherwise(0)).alias("hits"))


def _label_scores() -> dict[str, Column]:
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"precision": zero(F.col("hits"), F.col("predicted")), "recall": zero(F.col("hits"), F.col("support")),
            "f1": zero(2 * F.col("hits"), F.col("predicted") + F.col("support"))}


def per_class(counts: DataFrame, classes: int, keys: Sequence[str] = ("model",), amount: str = "n") -> DataFrame:
    """Precision, recall and F1 over a fixed label set; 0 where undefined."""
    grid = counts.select(*keys).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = grid.join(_label_counts(counts, keys, amount), [*keys, "label"], "left").na.fill(0, ["support", "predicted", "hits"])
    return full.withColumns(_label_scores())


def summary(counts: DataFrame, classes: int, keys: Sequence[str] = ("model",), amount: str = "n") -> DataFrame:
    """Agreement, balanced accuracy over the fixed label set, and macro-F1; a label that never occurs adds 0."""
    return _label_counts(counts, keys, amount).withColumns(_label_scores()).groupBy(*keys).agg(
        F.sum("support").alias("n"), F.try_divide(F.sum("hits"), F.sum("support")).alias("overall_agreement"),
        (F.sum("recall") / classes).alias("balanced_accuracy"), (F.sum("f1") / classes).alias("macro_f1"))


def probability_losses(predicted: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Clipped log loss and the unnormalised multiclass Brier score."""
    chosen = F.element_at("p", F.col("y").cast("int") + 1)
    squares = F.aggregate("p", F.lit(0.0), lambda s, q: s + q * q)
    return predicted.groupBy(*keys).agg(
        (-F.avg(F.log(F.greatest(F.least(chosen, F.lit(1.0)), F.lit(1e-15))))).alias("log_loss"),
        F.avg(squares - 2 * chosen + 1).alias("multiclass_brier"))


def one_vs_rest(predicted: DataFrame, keys: Sequence[str] = ("model",), amount: str | None = None) -> DataFrame:
    """AUROC (tie-aware Mann-Whitney) and average precision per class, and their macro means."""
    keys = list(keys)
    w = F.lit(1) if amount is None else F.col(amount)
    long = predicted.select(*keys, "y", w.alias("_w"), F.posexplode("p").alias("label", "s"))
    scores = long.groupBy(*keys, "label", "s").agg(
        F.sum("_w").alias("n"), F.sum(F.when(F.col("y") == F.col("label"), F.col("_w")).otherwise(0)).alias("pos"))
    group = [*keys, "label"]
    all_rows = value_positions(scores, group, "s", "n").withColumnRenamed("n", "m")
    hits = value_positions(scores, group, "s", "pos").select(*group, "value", F.col("before").alias("pb"))
    totals = scores.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    joined = (scores.withColumnRenamed("s", "value").join(all_rows, [*group, "value"]).join(hits, [*group, "value"], "left").join(totals, group)
              .where((F.col("pos") > 0) & (F.col("all_pos") < F.col("all_n"))))
    # negatives below a score = rows below - positives below; ties count half
    below = (F.col("before") - F.col("pb")) + (F.col("m") - F.col("pos")) / 2
    at_or_above, positives = F.col("all_n") - F.col("before"), F.col("all_pos") - F.col("pb")
    each = joined.groupBy(*group).agg(
        (F.sum(F.col("pos") * below) / F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("auroc"),
        (F.sum(F.col("pos") * positives / at_or_above) / F.max("all_pos")).alias("average_precision"))
    return each


def macro_curves(each: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return each.groupBy(*keys).agg(F.avg("auroc").alias("macro_auroc_ovr"), F.avg("average_precision").alias("macro_auprc"))


def calibration(predicted: DataFrame, keys: Sequence[str] = ("model",), bins: int = 10) -> DataFrame:
    """Top-label calibration table with empty bins kept; the last bin is closed."""
    keys = list(keys)
    binned = predicted.withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    grid = binned.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(binned, [*keys, "bin"], "left").withColumns({
        "count": F.coalesce("count", F.lit(0)), "bin_left": F.col("bin") / F.lit(float(bins)), "bin_right": (F.col("bin") + 1) / F.lit(float(bins))})


def expected_calibration_error(table: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    gap = F.col("count") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return table.groupBy(*keys).agg(F.try_divide(F.sum(F.coalesce(gap, F.lit(0.0))), F.sum("count")).alias("ece"))


def block_draws(predicted: DataFrame, classes: int, draws: int = 2000, keys: Sequence[str] = ("model",), seed: int = keyed.SEED) -> DataFrame:
    """Macro-F1 and agreement per draw of resampled blocks.

    Rows shrink to one confusion matrix per block first; a draw is a multiplicity of blocks, the same for every model.
    """
    keys = list(keys)
    cells = predicted.groupBy(*keys, "block", "y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    slots = numbered(predicted.select("block").distinct(), ["block"], "slot")
    slots = slots.withColumn("blocks", slots.agg(F.count(F.lit(1)).alias("n")).scalar())
    picks = slots.select("slot", "blocks", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(
        "draw", keyed.pick(F.col("blocks"), "test_blocks", "draw", "slot", seed=seed).alias("slot")).groupBy("draw", "slot").agg(F.count(F.lit(1)).alias("times"))
    weighted = picks.join(slots.select("slot", "block"), "slot").join(cells, "block").groupBy("draw", *keys, "y", "prediction").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"))
    return summary(weighted, classes, ["draw", *keys])


def draw_interval(draws: DataFrame, column: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias(f"{column}_ci_low_95"), F.col("_q")[1].alias(f"{column}_ci_high_95"))


def paired_difference(draws: DataFrame, primary: str, column: str = "macro_f1") -> DataFrame:
    """Interval of the difference to the primary model over the same draws."""
    base = draws.where(F.col("model") == primary).select("draw", F.col(column).alias("_b"))
    others = draws.where(F.col("model") != primary).join(base, "draw").withColumn("delta", F.col("_b") - F.col(column))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return others.groupBy(F.col("model").alias("comparator")).agg(F.avg("delta").alias("mean_delta"), q.alias("_q")).select(
        F.lit(primary).alias("primary"), "comparator", "mean_delta", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def probability_best(draws: DataFrame, column: str = "macro_f1") -> DataFrame:
    """Share of draws in which each model is best (first name on ties)."""
    best = draws.groupBy("draw").agg(F.min(F.struct((-F.col(column)).alias("v"), "model"))["model"].alias("model"))
    total = best.agg(F.count(F.lit(1)))
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("wins")).withColumn("probability_best", F.col("wins") / total.scalar())


def temperature_scaled(p: Column, t: Column) -> Column:
    """Softmax of log probabilities over a temperature."""
    logits = F.transform(p, lambda q: F.log(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-12))) / t)
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


def log_loss() -> Column:
    return -F.avg(F.log(F.greatest(F.element_at("p", F.col("y").cast("int") + 1), F.lit(1e-15))))


def fit_temperature(out_of_fold: DataFrame, low: float = 0.25, high: float = 4.0, points: int = 16, rounds: int = 3) -> DataFrame:
    """Model, temperature with the least log loss, by refining a grid for all models at once; each round is one aggregation of the rows.

    The rows must be predictions of models that did not see them.
    """
    bounds = out_of_fold.select("model").distinct().select("model", F.lit(low).alias("low"), F.lit(high).alias("high"))
    for _ in range(rounds):
        bounds = materialise(bounds)
        step = (F.col("high") - F.col("low")) / (points - 1)
        grid = bounds.select("model", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + i * step)).alias("t"))
        losses = out_of_fold.join(grid, "model").select("model", "y", "t", temperature_scaled(F.col("p"), F.col("t")).alias("p")).groupBy("model", "t").agg(log_loss().alias("loss"))
        best = losses.groupBy("model").agg(F.min(F.struct(F.round("loss", 12), "t"))["t"].alias("t"))
        bounds = bounds.drop("t").join(best, "model").select("model", F.greatest("low", F.col("t") - step).alias("low"), F.least("high", F.col("t") + step).alias("high"), "t")
    return materialise(bounds.select("model", F.col("t").alias("temperature")))
