"""Published results recomputed from published inputs."""

import pytest
from pyspark.sql import functions as F

from golden import ANNUAL_RAIN, DRY_RUNS, FACTOR_ROWS
from siterank.functions.columns import mean_of
from siterank.operators import checks, decision, metrics, scoring, trends
from siterank.operators.agreement import rank_agreement, spearman_interval
from siterank.operators.order import with_ranks


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(c, 500, *[v / 170 for v in f[:3]], *[v / 34 for v in f[3:6]], f[6]) for c, *f in FACTOR_ROWS]
    df = spark.createDataFrame(rows, ["component_id", "radius_m", *scoring.FACTORS, "published_rank"])
    df = df.withColumns(scoring.landscape_score()).withColumn(scoring.TERRAIN_SCORE, mean_of(list(scoring.TERRAIN)))
    return df.withColumn(scoring.PRIORITY, mean_of([scoring.LANDSCAPE, scoring.TERRAIN_SCORE])).cache()


@pytest.mark.parametrize("bounded", [True, False])
def test_fixed_rank(frame, bounded):
    ranked = with_ranks(frame, ["radius_m"], scoring.PRIORITY, "rank", "ordinal", tie="component_id", bounded=bounded)
    assert ranked.where(F.col("rank") != F.col("published_rank")).count() == 0
    assert ranked.where("rank = 1").first()[scoring.PRIORITY] == pytest.approx(0.5911764705882352)


@pytest.mark.parametrize("bounded", [True, False])
def test_factor_ablation(frame, bounded):
    out = {r["scenario"]: r for r in scoring.compare_alternatives(frame, scoring.factor_ablations(), F.col(scoring.PRIORITY), "scenario", bounded=bounded).collect()}
    # scenario: rho, tau, top-5 overlap, mean shift, max shift, leader
    published = {
        "Full hierarchy": (1.0, 1.0, 5, 0.0, 0.0, "c09"),
        "Landscape only": (0.3249540770190428, 0.1845031011541865, 1, 4.647058823529412, 11.0, "c04"),
        "Terrain only": (0.8297494129963187, 0.686586283020789, 4, 2.3529411764705883, 7.0, "c17"),
        "Without NDVI": (0.9914110429447854, 0.9481481481481482, 5, 0.47058823529411764, 1.0, "c09"),
        "Without MNDWI": (-0.279583130416384, -0.21402359733885637, 0, 6.9411764705882355, 13.0, "c17"),
        "Without wetness": (0.8920245398773007, 0.7481481481481482, 4, 1.7647058823529411, 4.0, "c18"),
    }
    for name, (rho, tau, top5, mean, high, leader) in published.items():
        r = out[name]
        assert r["spearman_rho"] == pytest.approx(rho, abs=1e-12) and r["kendall_tau"] == pytest.approx(tau, abs=1e-12)
        assert (r["top5_overlap"], r["rank_1_component"]) == (top5, leader)
        assert r["mean_absolute_rank_shift"] == pytest.approx(mean) and r["maximum_absolute_rank_shift"] == high


def test_weighting_baselines(frame):
    out = {r["baseline"]: r["spearman_rho"] for r in scoring.baseline_comparison(frame, bounded=True).collect()}
    assert out["CRITIC weighting"] == pytest.approx(0.9724097474569846, abs=1e-9)
    assert out["Entropy weighting"] == pytest.approx(0.7480074980438344, abs=1e-9)
    assert out["Ungrouped equal-factor mean"] == pytest.approx(0.8441717791411044, abs=1e-9)
    assert out["Oriented first principal component"] == pytest.approx(-0.7713060922451996, abs=1e-9)


def test_exact_leaders(frame):
    intervals = decision.top_intervals(frame).cache()
    leaders = [(r["component_id"], r["w_lower"], r["w_upper"]) for r in decision.leader_intervals(intervals).orderBy("w_lower").collect()]
    assert [c for c, _, _ in leaders] == ["c17", "c09", "c08", "c04"]
    assert [u for _, _, u in leaders] == pytest.approx([0.1047120418848164, 0.7692307692307689, 0.7857142857142856, 1.0], abs=1e-12)
    everything = decision.rank_intervals(frame).cache()
    assert everything.select("w_lower").distinct().count() == 69
    mass = decision.uniform_top3_mass(intervals, frame).agg(F.sum("exact_uniform_top3"), F.max("total_weight_mass"), F.min("total_weight_mass")).first()
    assert tuple(mass) == pytest.approx((3.0, 1.0, 1.0), abs=1e-9)
    # Monte Carlo over uniform weights agrees with the exact mass
    sampled = decision.summarise_ranks(decision.beta_weight_ranks(frame, [1.0], draws=20_000), ["component_id"])
    gap = sampled.join(decision.uniform_top3_mass(intervals, frame), "component_id").agg(F.max(F.abs(F.col("probability_top_3") - F.col("exact_uniform_top3")))).first()[0]
    assert gap < 0.015
    # the swept levels are those of the full arrangement
    both = decision.uniform_top3_mass(everything, frame).join(decision.uniform_top3_mass(intervals, frame).withColumnRenamed("exact_uniform_top3", "swept"), ["radius_m", "component_id"])
    assert both.count() == 17 and both.agg(F.max(F.abs(F.col("exact_uniform_top3") - F.col("swept")))).first()[0] < 1e-9


def test_annual_trends(spark):
    rows = [(m, 1991 + i, float(v)) for m, s in (("rain", ANNUAL_RAIN), ("dry", DRY_RUNS)) for i, v in enumerate(s)]
    long = spark.createDataFrame(rows, ["metric", "x", "y"])
    out = {r["metric"]: r for r in trends.trend_table(long, ["metric"], "x", "y", draws=400).collect()}
    rain, dry = out["rain"], out["dry"]
    assert rain["slope"] == pytest.approx(-10.303703703703693, abs=1e-9)
    assert rain["intercept"] == pytest.approx(21598.03703703702, abs=1e-6)
    assert (rain["slope_low_95"], rain["slope_high_95"]) == pytest.approx((-17.93666666666667, -2.5642857142856883), abs=1e-9)
    assert rain["kendall_tau"] == pytest.approx(-0.30084033613445377, abs=1e-12)
    assert rain["effective_n"] == pytest.approx(17.733210169098335, abs=1e-9)
    assert dry["effective_n"] == 35
    assert dry["slope"] == pytest.approx(1 / 6) and dry["kendall_tau"] == pytest.approx(0.08998769120481312, abs=1e-12)
    assert dry["kendall_p_unadjusted"] == pytest.approx(0.4510, abs=2e-3)
    # the published interval comes from other random numbers
    assert rain["block_low_95"] == pytest.approx(-17.91, abs=2.0) and rain["block_high_95"] == pytest.approx(-2.67, abs=2.0)
    assert rain["block_p"] < 0.05 < dry["block_p"]


def test_exact_binomial_interval(spark):
    df = spark.createDataFrame([(17, 27), (23, 27), (24, 27), (0, 27), (27, 27)], ["k", "n"])
    out = {r["k"]: (r["p_ci_low_95"], r["p_ci_high_95"]) for r in checks.with_exact_interval(df, "k", "n", "p").collect()}
    assert out[17] == pytest.approx((0.42367957250429583, 0.8059928412848649), abs=1e-9)
    assert out[23] == pytest.approx((0.6626891359757556, 0.9581126035262327), abs=1e-9)
    assert out[0][0] == 0.0 and out[27][1] == 1.0


def test_spearman_interval(spark):
    low, high = spearman_interval(F.col("r"), F.col("n"))
    row = spark.createDataFrame([(0.8441717791411044, 17)], ["r", "n"]).select(low, high).first()
    assert tuple(row) == pytest.approx((0.5549234229358458, 0.9513263782849353), abs=1e-12)


def test_confusion_metrics(spark):
    matrix = [[729, 63, 93, 0, 2, 0], [56, 663, 8, 0, 2, 1], [39, 45, 772, 21, 60, 0], [1, 0, 26, 569, 89, 0], [6, 21, 124, 12, 696, 0], [1, 29, 0, 0, 0, 60]]
    rows = [("m", i, j, n) for i, line in enumerate(matrix) for j, n in enumerate(line) if n]
    got = metrics.summary(spark.createDataFrame(rows, ["model", "y", "prediction", "n"]), 6).first()
    assert got["macro_f1"] == pytest.approx(0.8307954, abs=1e-7) and got["overall_agreement"] == pytest.approx(0.8330946, abs=1e-7)


def test_tied_ranking_gives_null(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(9)], ["i", "a", "b"])
    got = rank_agreement(df, [], "a", "b").first()
    assert got["rho"] is None and got["tau"] is None
