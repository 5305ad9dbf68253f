"""Declarative data-quality and evidence checks. Every check is a row, computed where the data is."""

from __future__ import annotations

from collections.abc import Sequence

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed labels and patterns of the secret scan.
SECRET_PATTERNS = {
    "GitHub token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,})",
    "OpenAI key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "AWS access key": r"AKIA[0-9A-Z]{16}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def check(name: str, observed: Column, expected: Column | float, tolerance: float = 0.0, severity: str = "error", implication: str = "") -> Column:
    """V1: one check record; it passes when observed is within the tolerance of expected."""
    o = observed.cast("double")
    e = (expected if isinstance(expected, Column) else F.lit(float(expected))).cast("double")
    return F.struct(F.lit(name).alias("check_id"), F.coalesce(F.abs(o - e) <= tolerance, F.lit(False)).alias("passed"), F.lit(severity).alias("severity"),
                    o.alias("observed"), e.alias("expected"), F.lit(float(tolerance)).alias("tolerance"), F.lit(implication).alias("implication"))


def records(summary: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """Check rows from a one-row summary."""
    return summary.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def table_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, NULL cells, rows with a repeated key and fully repeated rows; keys combine before the totals."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    whole = F.struct(*df.columns)
    rows = df.select(*keys, nulls.alias("_n"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("_h")).groupBy(*keys, "_h").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_n").alias("_n"))
    per_key = rows.groupBy(*keys).agg(F.sum("_c").alias("_k"), F.sum("_n").alias("_n"), F.sum(F.col("_c") - 1).alias("_d"))
    return per_key.agg(F.sum("_k").alias("rows"), F.sum("_n").alias("null_cells"), F.sum(F.col("_k") - 1).alias("duplicate_key_rows"), F.sum("_d").alias("duplicate_rows"))


def grain_checks(df: DataFrame, keys: Sequence[str], rows: Column | int, domains: dict[str, Sequence]) -> DataFrame:
    """V2: row count, unique key, no NULL cell and the exact domain of small columns."""
    profile = table_profile(df, keys)
    found = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in domains])
    domain = [F.array_sort(F.array(*[F.lit(v) for v in values])) == F.col(f"_d.{c}") for c, values in domains.items()]
    summary = profile.withColumn("_d", found.select(F.struct(*domains)).scalar())
    return records(summary, [
        check("row_count", F.col("rows"), rows), check("unique_key", F.col("duplicate_key_rows"), 0), check("no_null_cells", F.col("null_cells"), 0),
        *[check(f"domain_{c}", d.cast("int"), 1) for c, d in zip(domains, domain)]])


def grid_alignment(cells: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """V4: extent and count of every cell table against the grid contract."""
    rows = cells.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n"))
    out = rows.groupBy(*keys).agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
                                  F.count(F.lit(1)).alias("cells"), F.sum(F.col("_n") - 1).alias("repeated_cells"))
    inside = (F.col("row_min") >= 0) & (F.col("row_max") < height) & (F.col("col_min") >= 0) & (F.col("col_max") < width) & (F.col("repeated_cells") == 0)
    return out.withColumn("aligned", inside)


def role_contract(df: DataFrame, block: str, legacy: str | None = None) -> DataFrame:
    """V5: rows and blocks per spatial role, and rows where a legacy role column disagrees."""
    from siterank.functions.columns import split_role

    tagged = df.withColumn("role", split_role(block))
    differs = F.lit(0) if legacy is None else (F.col(legacy) != F.col("role")).cast("int")
    return tagged.groupBy("role", block).agg(F.count(F.lit(1)).alias("_n"), F.sum(differs).alias("_d")).groupBy("role").agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("blocks"), F.sum("_d").alias("legacy_mismatches"))


def probability_checks(predictions: DataFrame, classes: int) -> DataFrame:
    """V6: rows whose probabilities leave [0, 1], do not sum to one, or whose class lies outside the domain."""
    total = F.aggregate("p", F.lit(0.0), lambda s, q: s + q)
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.exists("p", lambda q: (q < 0) | (q > 1))).alias("outside_unit_interval"),
        F.count_if(F.abs(total - 1) > 1e-6).alias("not_summing_to_one"), F.count_if(~F.col("y").between(0, classes - 1)).alias("class_outside_domain"))


def bounds(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """V7: values outside [low, high] per column."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).between(low, high)).alias(c) for c in columns]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outside")) for c in columns])).alias("o")).select("o.*")


def interval_checks(df: DataFrame, p: str, low: str, high: str, keys: Sequence[str] = ()) -> DataFrame:
    """P inside [0, 1] and ordered, present intervals."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(p).isNotNull() & ~F.col(p).between(0, 1)).alias("p_outside"),
        F.count_if(F.col(low).isNull() | F.col(high).isNull()).alias("interval_missing"), F.count_if(F.col(low) > F.col(high)).alias("interval_reversed"))


def reproduction(recomputed: DataFrame, frozen: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Recomputed against frozen values: rows, largest and mean absolute difference, pass."""
    entries = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("o")).select(*keys, "o.*")
    both = entries(recomputed).join(entries(frozen).withColumnRenamed("v", "_f"), [*keys, "metric"])
    gap = F.abs(F.col("v") - F.col("_f"))
    return both.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("max_abs_difference"), F.avg(gap).alias("mean_abs_difference")).withColumn(
        "pass", F.col("max_abs_difference") <= tolerance)


def secret_scan(texts: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """V9: (ids, pattern) for every text that matches a secret pattern."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()]), lambda x: x.isNotNull())
    return texts.select(*ids, F.explode(hits).alias("pattern"))


_INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(_INTERVAL)
def _exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_clopper_pearson(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"])


def _upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p)."""
    if p <= 0 or p >= 1:
        return float(k <= 0) if p <= 0 else 1.0
    base = math.lgamma(n + 1)
    return math.fsum(math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def _bisect(rising, target: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if rising(mid) < target else (low, mid)
    return (low + high) / 2


def _clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low = 0.0 if k == 0 else _bisect(lambda p: _upper_tail(k, n, p), alpha / 2)
    high = 1.0 if k == n else _bisect(lambda p: _upper_tail(k + 1, n, p), 1 - alpha / 2)
    return low, high


def with_exact_interval(df: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    """Clopper-Pearson bounds of k out of n, solved once per distinct pair."""
    pairs = df.select(F.col(k).alias("_k"), F.col(n).alias("_n")).distinct().withColumn("_ci", _exact_interval("_k", "_n"))
    pairs = pairs.select("_k", "_n", F.col("_ci.low").alias(f"{prefix}_ci_low_95"), F.col("_ci.high").alias(f"{prefix}_ci_high_95"))
    return df.join(pairs, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n"))).drop("_k", "_n")


def tier_intervals(stability: DataFrame) -> DataFrame:
    """Exact intervals of the top-set frequencies and whether the top-five interval spans one half."""
    counted = stability.withColumns({f"top{k}_count": F.round(F.col(f"top{k}_frequency") * F.col("scenarios")).cast("int") for k in (3, 5)})
    out = with_exact_interval(with_exact_interval(counted, "top3_count", "scenarios", "top3"), "top5_count", "scenarios", "top5")
    return out.withColumn("top5_interval_spans_half", (F.col("top5_ci_low_95") < 0.5) & (F.col("top5_ci_high_95") > 0.5))


def evidence_cross_check(evidence: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """External evidence rows with rank and acceptability; an entity without a rank keeps NULLs."""
    return evidence.join(ranks, key, "left").withColumn("in_core_tier", F.coalesce(F.col("rank") <= 5, F.lit(False)))
