"""Brute-force and property tests on small fixtures."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siterank.functions import columns as C, geodesy, keyed
from siterank.operators import benchmark, checks, daily, decision, metrics, raster, sampling, spatial, terrain, trends
from siterank.operators.agreement import rank_agreement
from siterank.operators import order
from siterank.operators.order import by_size, numbered, quantiles, quantiles_of_cells, quantiles_wide, with_percentile, with_ranks
from siterank.sources import grids, manifest, tables, vectors, weather


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice([None, rng.gauss(0, 1e3), rng.gauss(0, 1e-7), float(rng.randint(-5, 5))])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_bucketed_quantiles_match_numpy(values):
    rows, df = values
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for bounded in (False, True):
        for r in quantiles(df, ["g"], {"v": "v"}, probs, bounded=bounded).collect():
            data = [v for g, v in rows if g == r["g"] and v is not None]
            assert r["n"] == len(data)
            assert [r[p] for p in probs] == pytest.approx(np.quantile(data, list(probs.values())).tolist(), rel=1e-12, abs=1e-15)


def test_weighted_quantile_is_the_quantile_of_the_multiset(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2), (5.0, 0)], ["v", "w"])
    got = quantiles(df, [], {"v": "v"}, {"m": 0.5}, weight="w").first()
    assert got["m"] == np.median([1, 1, 1, 2, 9, 9]) and got["n"] == 6


def test_bucketed_ranks_equal_windows(values):
    _, df = values
    df = df.withColumn("id", F.monotonically_increasing_id()).cache()
    for method in ("average", "min", "ordinal"):
        both = with_ranks(with_ranks(df, ["g"], "v", "a", method, tie="id"), ["g"], "v", "b", method, tie="id", bounded=True)
        assert both.where("not (a <=> b)").count() == 0
    for high in (True, False):
        both = with_percentile(with_percentile(df, ["g"], {"a": ("v", high)}, ["id"]), ["g"], {"b": ("v", high)}, ["id"], bounded=True)
        assert both.where("not (a <=> b)").count() == 0


def test_kendall_counts_equal_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20), rng.randint(0, 9)) for _ in range(150)]
    s = sum(np.sign((a - c) * (b - d)) for i, (a, b) in enumerate(rows) for c, d in rows[:i])
    df = spark.createDataFrame(rows, ["x", "y"])
    for bounded in (True, False):
        got = rank_agreement(df, [], "x", "y", bounded).first()
        assert got["s"] == s and got["n"] == 150
        # ranges of a few positions: ties larger than a range, pairs in one range and across ranges
        small = rank_agreement(df, [], "x", "y", bounded, bucket=4).first()
        assert small["s"] == s and small["tau"] == got["tau"] and small["rho"] == got["rho"]


def test_kendall_of_skewed_keys(spark):
    """A third of all rows share one x, another third one y; no range holds them all."""
    rows = [(0, 5 if i % 3 == 0 else (i * 37) % 91, 4 if i % 3 == 1 else (i * 53) % 97) for i in range(600)] + [(None, i % 5, i % 7) for i in range(35)]
    df = spark.createDataFrame(rows, "k int, x int, y int")
    want = {}
    for key in (0, None):
        part = [(x, y) for k, x, y in rows if k == key]
        want[key] = sum(int(np.sign((a - c) * (b - d))) for i, (a, b) in enumerate(part) for c, d in part[:i])
    got = rank_agreement(df.withColumn("k", F.coalesce("k", F.lit(-1))), ["k"], "x", "y", bucket=50).collect()
    assert {r["k"]: r["s"] for r in got} == {0: want[0], -1: want[None]}


def test_runs_windows_and_gaps(spark):
    wet = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(2001, f"2001-01-{i + 1:02d}", w) for i, w in enumerate(wet)], ["year", "date", "w"]).withColumn("date", F.to_date("date"))
    out = daily.with_runs(df, ["year"], {"run": F.col("w") == 1}).agg(F.max("run")).first()[0]
    assert out == 3
    r5 = df.withColumn("r5", daily.rolling_total(["year"], F.col("w"))).agg(F.max("r5"), F.count("r5")).first()
    assert tuple(r5) == (4, 5)
    cells = df.where("date <> '2001-01-04'").select(F.lit("OM_01").alias("weather_cell_id"), "date")
    assert [str(r["date"]) for r in daily.calendar_gaps(cells, "2001-01-01", "2001-01-09").collect()] == ["2001-01-04"]


def test_lag_sum_needs_every_day(spark):
    days = spark.createDataFrame([(f"2001-01-{d:02d}", None if d == 5 else 1.0) for d in range(1, 11)], ["date", "precipitation_sum"]).select(
        F.to_date("date").alias("date"), "precipitation_sum", F.lit(1.0).alias("temperature_2m_mean"), F.lit(2.0).alias("temperature_2m_max"), F.lit(3.0).alias("relative_humidity_2m_mean"))
    scenes = spark.createDataFrame([("a", "2001-01-05"), ("b", "2001-01-10")], ["item_id", "acquisition_date"]).withColumn("acquisition_date", F.to_date("acquisition_date"))
    got = {r["item_id"]: r for r in daily.lag_features(scenes, days, ["item_id"], lags=[4, 7]).collect()}
    assert got["a"]["precipitation_preceding_4d_mm"] == 4.0 and got["a"]["precipitation_preceding_7d_mm"] is None
    assert got["b"]["precipitation_preceding_4d_mm"] == 4.0 and got["b"]["precipitation_preceding_7d_mm"] is None


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.9]
    got = {r["i"]: r["q"] for r in trends.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q", tie=["i"]).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, None, 0.9])


def test_constant_series_is_not_tested(spark):
    df = spark.createDataFrame([("c", i, 2.0) for i in range(12)], ["metric", "x", "y"])
    got = trends.trend_table(df, ["metric"], "x", "y", draws=20).first()
    assert got["status"] == "INSUFFICIENT_OR_CONSTANT" and got["block_p"] is None and got["slope"] is None


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("u", keyed.uniform("s", "id"))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in spark.range(200).repartition(7).withColumn("u", keyed.uniform("s", "id")).collect()}
    for alpha, spread in ((0.5, 1 / 8), (1.0, 1 / 12), (2.0, 1 / 20)):
        m = spark.range(20000).select(keyed.symmetric_beta(alpha, "b", "id").alias("b")).agg(F.avg("b"), F.var_pop("b"), F.min("b"), F.max("b")).first()
        assert m[0] == pytest.approx(0.5, abs=0.01) and m[1] == pytest.approx(spread, abs=0.004) and m[2] >= 0 and m[3] <= 1


def _dem(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row bigint, col bigint, elev double")


def test_flow_and_distance_against_loops(spark):
    rng = np.random.default_rng(4)
    z = rng.integers(0, 30, (12, 9)).astype(float)
    cy, cx = 3.0, 2.0
    receivers = terrain.d8_receiver(_dem(spark, z), cy, cx)
    to = {(r["row"], r["col"]): (r["to_row"], r["to_col"]) for r in receivers.collect()}
    for (r, c), target in to.items():
        falls = []
        for i, (dr, dc) in enumerate(terrain.DIRECTIONS):
            if 0 <= r + dr < 12 and 0 <= c + dc < 9:
                falls.append((np.float32((z[r, c] - z[r + dr, c + dc]) / math.hypot(cy * dr, cx * dc)), -i, (r + dr, c + dc)))
        best = max(falls)
        assert target == (best[2] if best[0] > 0 else (None, None))
    flow = {(r["row"], r["col"]): r["flow"] for r in terrain.flow_accumulation(receivers, 9).collect()}
    loops = dict.fromkeys(to, 0)
    for cell in to:
        while cell[0] is not None:
            loops[cell] += 1
            cell = to[cell]
    assert flow == loops
    for targets in ([(0, 0), (11, 8)], [(2, 2), (2, 3), (3, 2)], [(5, 4)], [tuple(p) for p in rng.integers(-4, 15, (20, 2)).tolist()]):
        near = spatial.nearest_on_grid(_dem(spark, z), spark.createDataFrame(targets, ["row", "col"]), [], cy, cx)
        got = {(r["row"], r["col"]): r["distance"] for r in near.collect()}
        assert len(got) == 108
        for (r, c), d in got.items():
            assert d == pytest.approx(min(math.hypot((r - a) * cy, (c - b) * cx) for a, b in targets), abs=1e-12)
    none = spatial.nearest_on_grid(_dem(spark, z), spark.createDataFrame([], "row long, col long"), [], cy, cx)
    assert none.count() == 108 and none.where("distance is not null").isEmpty()


def test_distances_of_clustered_targets(spark):
    """All targets in one corner of a wide grid: two passes, no rounds, and keys are kept."""
    cells = spark.range(300 * 200).select(F.expr("id div 200").alias("row"), (F.col("id") % 200).alias("col"), (F.col("id") % 3).alias("g"))
    targets = cells.where("row < 3 and col < 3").select("row", "col")
    far = spatial.nearest_on_grid(cells, targets, ["g"], 30.0, 25.0)
    dr, dc = F.greatest(F.col("row") - 2, F.lit(0)) * 30.0, F.greatest(F.col("col") - 2, F.lit(0)) * 25.0
    assert far.count() == 60_000 and far.where(F.abs(F.col("distance") - F.sqrt(dr * dr + dc * dc)) > 1e-9).isEmpty()
    plan = spatial.nearest_on_grid(cells, targets, [], 30.0, 25.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan


def test_neighbourhoods_of_a_grid_with_gaps(spark):
    """Absent cells give NULL or one-sided values, whatever the tile; neighbours are those by position."""
    rng = np.random.default_rng(12)
    z = rng.integers(0, 60, (23, 19)).astype(float)
    gone = {(int(a), int(b)) for a, b in rng.integers(0, 19, (25, 2))} | {(7, c) for c in range(19)}
    cells = spark.createDataFrame([(r - 4, c - 3, float(z[r, c]), "kept") for r in range(23) for c in range(19) if (r, c) not in gone], "row bigint, col bigint, elev double, note string")
    have = {(r - 4, c - 3): z[r, c] for r in range(23) for c in range(19) if (r, c) not in gone}
    low, high = (min(k[0] for k in have), min(k[1] for k in have)), (max(k[0] for k in have), max(k[1] for k in have))
    for side in (5, 128):
        rough = {(r["row"], r["col"]): r for r in terrain.roughness(cells, 3, 7, side).collect()}
        steep = {(r["row"], r["col"]): r["slope_deg"] for r in terrain.slope(cells, 3.0, 2.0, side).collect()}
        flows = {(r["row"], r["col"]): (r["to_row"], r["to_col"]) for r in terrain.d8_receiver(cells, 3.0, 2.0, side).collect()}
        assert set(rough) == set(steep) == set(flows) == set(have) and rough[next(iter(have))]["note"] == "kept"
        for (r, c), h in have.items():
            clamp = lambda dr, dc: have.get((min(max(r + dr, low[0]), high[0]), min(max(c + dc, low[1]), high[1])))
            square = lambda k: [clamp(dr, dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1)]
            small, wide = square(1), square(3)
            assert rough[r, c]["tri"] == (None if None in small else pytest.approx(float(np.std(small)), abs=1e-9))
            assert rough[r, c]["tpi"] == (None if None in wide else pytest.approx(h - float(np.mean(wide)), abs=1e-9))
            grads = []
            for (a, b), step in ((((-1, 0), (1, 0)), 3.0), (((0, -1), (0, 1)), 2.0)):
                back, ahead = have.get((r + a[0], c + a[1])), have.get((r + b[0], c + b[1]))
                grads.append((ahead - back) / (2 * step) if None not in (back, ahead) else (ahead - h) / step if ahead is not None else (h - back) / step if back is not None else None)
            assert steep[r, c] == (None if None in grads else pytest.approx(math.degrees(math.atan(math.hypot(*grads))), abs=1e-9))
            falls = [(np.float32((h - have[r + dr, c + dc]) / math.hypot(3.0 * dr, 2.0 * dc)), -i, (r + dr, c + dc)) for i, (dr, dc) in enumerate(terrain.DIRECTIONS) if (r + dr, c + dc) in have]
            best = max(falls, default=(0,))
            assert flows[r, c] == (best[2] if best[0] > 0 else (None, None))


def test_cycle_is_reported(spark):
    loop = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], ["row", "col", "to_row", "to_col"])
    with pytest.raises(RuntimeError):
        terrain.flow_accumulation(loop, 2)


def test_polygon_with_hole_and_edges(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    polygons = spark.createDataFrame([("p", [[square(0.0, 10.0), square(4.0, 6.0)]])], "pid string, rings array<array<array<array<double>>>>")
    points = spark.createDataFrame([("in", 2.0, 2.0), ("hole", 5.0, 5.0), ("edge", 10.0, 3.0), ("corner", 0.0, 0.0), ("out", 11.0, 5.0), ("hole_edge", 4.0, 5.0)], ["id", "x", "y"])
    got = {r["id"] for r in spatial.points_in_polygons(points, polygons, ["id"], ["pid"], 3.0).where("inside").collect()}
    assert got == {"in", "edge", "corner"}


def test_projection(spark):
    df = spark.createDataFrame([(72.82, 33.75), (75.0, 10.0), (73.5, 45.0)], ["lon", "lat"])
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geodesy.from_utm(e, n)
    for r in df.select("lon", "lat", e.alias("e"), n.alias("n"), lon.alias("a"), lat.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=5e-8)
    assert df.where("lon = 75").select(e).first()[0] == pytest.approx(500000.0)


def test_disc_join_is_inclusive_and_skips_unlocated(spark):
    points = spark.createDataFrame([("a", 105.0, -105.0), ("b", None, None)], "component_id string, x double, y double")
    got = raster.disc_cells(points, [30, 60], 0.0, 0.0, 30.0).groupBy("radius_m").count().collect()
    assert {r["radius_m"]: r["count"] for r in got} == {30: 5, 60: 13}


def test_class_ties_go_to_the_lowest(spark):
    fine = spark.createDataFrame([(1, 0, 0, 4), (1, 0, 1, 2), (1, 0, 2, 4), (1, 1, 0, 2), (1, 1, 1, 0), (1, 3, 3, 0)], ["year", "row", "col", "lc_class"])
    got = {(r["row"], r["col"]): (r["majority"], r["count"]) for r in raster.majority_purity(fine).collect()}
    assert got == {(0, 0): (2, 2), (1, 1): (0, 0)}


def test_spread_sample_is_the_greedy_choice(spark):
    rng = random.Random(1)
    cells = list({(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(120)})
    df = spark.createDataFrame([("s", r, c) for r, c in cells], ["k", "row", "col"])
    hashes = {(r["row"], r["col"]): r["u"] for r in df.withColumn("u", keyed.uniform("spread", "k", "row", "col")).collect()}
    greedy = []
    for cell in sorted(cells, key=hashes.get):
        if all(max(abs(cell[0] - a), abs(cell[1] - b)) >= 3 for a, b in greedy):
            greedy.append(cell)
    out = sampling.spread_sample(df, ["k"], 3, len(greedy) + 4).collect()
    assert {(r["row"], r["col"]) for r in out if r["spaced"]} == set(greedy)
    assert len(out) == len(greedy) + 4 and sorted(r["sequence"] for r in out) == list(range(1, len(out) + 1))


def test_empty_calibration_bins_and_missing_class(spark):
    rows = [("m", 1, 0, 0, [0.95, 0.05, 0.0]), ("m", 2, 0, 1, [0.45, 0.55, 0.0]), ("m", 3, 1, 0, [1.0, 0.0, 0.0])]
    p = metrics.with_prediction(spark.createDataFrame(rows, "model string, id int, block int, y int, p array<double>"))
    table = metrics.calibration(p)
    assert table.count() == 10 and table.where("count > 0").count() == 2
    assert metrics.summary(metrics.confusion(p), 3).first()["macro_f1"] == pytest.approx(2 / 3)


def test_qa_masks(spark):
    rows = [(64, 0, 2, "landsat-8"), (8, 0, 2, "landsat-8"), (64, 1, 2, "landsat-8"), (64, 0, 192, "landsat-8"), (64, 0, 34, "landsat-8"), (64, 0, None, "landsat-7")]
    df = spark.createDataFrame(rows, "qa_pixel int, qa_radsat int, qa_aerosol int, platform string")
    got = df.select(C.clear_pixel(), C.strict_clear_pixel()).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, False), (True, False), (True, True)]


def test_sources(spark, tmp_path):
    values = np.arange(2 * 3 * 5, dtype="<f4").reshape(5, 3, 2)
    values[1, 1, 0] = -9999
    (tmp_path / "grid.f32").write_bytes(values.tobytes())
    cells = grids.read_grid(spark, str(tmp_path / "grid.f32"), "<f4", 3, 5, ["a", "b"], rows_per_partition=2)
    got = {(r["row"], r["col"]): (r["a"], r["b"]) for r in cells.collect()}
    assert got[(4, 2)] == (28.0, 29.0) and got[(1, 1)] == (None, 9.0) and len(got) == 15
    tile = np.array([[1, 2], [-32768, 4]], dtype=">i2")
    (tmp_path / "t.hgt.gz").write_bytes(gzip.compress(tile.tobytes()))
    dem = {(r["row"], r["col"]): r for r in grids.read_elevation(spark, str(tmp_path / "t.hgt.gz"), 34.0, 72.0, 2).collect()}
    assert dem[(1, 0)]["elev"] is None and dem[(1, 1)]["elev"] == 4.0 and dem[(1, 1)]["latitude"] == 33.0
    (tmp_path / "OM_01_era5_daily.json").write_text(json.dumps({"daily": {"time": ["2001-01-01", "2001-01-02"], "t": [1.5, -999.0]}}))
    rows = weather.read_column_json(spark, str(tmp_path / "OM_01_era5_daily.json"), ["t"]).orderBy("date").collect()
    assert [(r["weather_cell_id"], str(r["date"]), r["t"]) for r in rows] == [("OM_01", "2001-01-01", 1.5), ("OM_01", "2001-01-02", None)]
    (tmp_path / "n.json").write_text(json.dumps({"properties": {"parameter": {"T2M": {"20010101": 3.0}, "PRECTOTCORR": {"20010101": -999.0}}}}))
    r = weather.read_map_json(spark, str(tmp_path / "n.json")).first()
    assert r["temperature_2m_mean"] == 3.0 and r["precipitation_sum"] is None
    points = {"features": [{"id": "a", "properties": {"component_id": "a", "name": "A"}, "geometry": {"type": "Point", "coordinates": [72.5, 33.5]}},
                           {"id": "b", "properties": {"component_id": "b", "name": "B"}, "geometry": None}]}
    (tmp_path / "p.geojson").write_text(json.dumps(points))
    assert vectors.read_points(spark, str(tmp_path / "p.geojson"), projected=False).count() == 1
    both = vectors.read_points(spark, str(tmp_path / "p.geojson"), projected=False, keep_unlocated=True)
    one = lambda name: spark.createDataFrame([("a", 1.0)], ["component_id", name])
    features = [json.loads(r["value"]) for r in vectors.enriched_features(both, one("score"), one("rank"), one("rank_low")).collect()]
    assert {f["id"]: (f["geometry"] is None, f["properties"]["rank"]) for f in features} == {"a": (False, 1.0), "b": (True, None)}


def test_sinks_manifest_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    tables.write_json_records(df, str(tmp_path / "j"))
    assert tables.read_table(spark, str(tmp_path / "t"), "i int, s string").count() == 2
    assert set(tables.read_tables(spark, {"t": (str(tmp_path / "t"), "i int, s string", "csv"), "gone": (str(tmp_path / "no"), "i int", "csv")})) == {"t"}
    assert {json.loads(r["value"])["s"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {None, "x"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("abc")
    found = manifest.manifest(spark, str(tmp_path / "m"))
    row = found.first()
    assert (row["relative_path"], row["bytes"]) == ("a.csv", 3) and row["sha256"].startswith("ba7816bf")
    expected = spark.createDataFrame([("a.csv", "00"), ("b.csv", "11")], ["relative_path", "sha256"])
    assert {r["relative_path"]: r["status"] for r in manifest.verify_checksums(found, expected).collect()} == {"a.csv": "hash_mismatch", "b.csv": "missing"}
    assert manifest.inventory(spark, str(tmp_path / "m")).first()["workflow_role"] == "tabular_data_or_result"
    secret = spark.createDataFrame([(1, "key AKIA" + "A" * 16), (2, "plain"), (3, "-----BEGIN PRIVATE KEY-----")], ["i", "t"])
    assert {(r["i"], r["pattern"]) for r in checks.secret_scan(secret, ["i"], "t").collect()} == {(1, "AWS access key"), (3, "private key")}


def test_temperature_recovers_sharpness(spark):
    rows = [(i % 2, [0.7, 0.3] if (i % 10 < 9) == (i % 2 == 0) else [0.3, 0.7]) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, p array<double>").withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    found = metrics.fit_temperature(df).collect()
    assert sorted(r["model"] for r in found) == ["a", "b"] and all(0.25 <= r["temperature"] < 1.0 for r in found)


def _brute_slopes(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    run, rise = x[:, None] - x, y[:, None] - y
    return np.sort(rise[run > 0] / run[run > 0])


def test_slopes_found_by_counting_equal_listed_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    series = {"noise": (np.arange(60), rng.normal(size=60) + 0.3 * np.arange(60)), "ties": (rng.integers(0, 12, 70), rng.integers(0, 9, 70)), "down": (np.arange(40) / 4, -2.5 * np.arange(40)), "flat": (np.arange(30), np.zeros(30)), "short": ([1, 2], [5, 9]), "one": ([1], [1]), "same": ([3, 3, 3], [1, 2, 4])}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in series.items() for a, b in zip(x, y)] + [("noise", None, 1.0)], "k string, x double, y double").repartition(3)
    listed = {r["k"]: r for r in trends.theil_sen(df, ["k"], "x", "y").collect()}
    for name, (x, y) in series.items():
        slopes = _brute_slopes(x, y)
        if len(slopes):
            assert listed[name]["slope"] == pytest.approx(float(np.median(slopes)), abs=1e-12) and listed[name]["pairs"] == len(slopes)
            assert listed[name]["residual_offset"] == pytest.approx(float(np.median(np.asarray(y, float) - listed[name]["slope"] * np.asarray(x, float))), abs=1e-9)
        else:
            assert listed[name]["slope"] is None
    monkeypatch.setattr(trends, "SMALL", 20)
    counted = {r["k"]: r for r in trends.theil_sen(df, ["k"], "x", "y", tolerance=1e-12, bucket=16).collect()}
    for name in series:
        for c in ("slope", "slope_low_95", "slope_high_95", "intercept", *(() if name == "down" else ("lag1", "effective_n"))):  # a line leaves no residuals
            a, b = listed[name][c], counted[name][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-8)), (name, c)


def test_million_points(spark):
    """A series far beyond any listing of its slopes; half of the points lie on a line."""
    x = F.col("id").cast("double")
    noise = F.when(F.col("id") % 2 == 0, 0.0).otherwise((keyed.uniform("n", "id") - 0.5) * 1000)
    points = spark.range(1_000_000).select(F.lit("s").alias("k"), x.alias("x"), (x * 0.75 + noise).alias("y"))
    stats = points.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2")).withColumn("ks", F.array(F.expr("pairs div 2")))
    got = trends.order_slopes(points, stats, ["k"], tolerance=1e-5).first()["slopes"]
    assert got[0] == pytest.approx(0.75, abs=1e-5)


def test_top_levels_in_small_buckets(spark):
    """Buckets of five lines and the slabs after them give the levels of one sweep."""
    rng = np.random.default_rng(8)
    rows = [(int(radius), f"c{i:03d}", float(a), float(b)) for radius in (250, 500) for i, (a, b) in enumerate(rng.integers(0, 40, (60, 2)) / 40)] + [(500, "none", None, 0.5)]
    frame = spark.createDataFrame(rows, ["radius_m", "component_id", decision.LANDSCAPE, decision.TERRAIN_SCORE])
    order = lambda df: [(r["radius_m"], r["rank"], r["component_id"], round(r["w_lower"], 9), round(r["w_upper"], 9)) for r in df.orderBy("radius_m", "rank", "w_lower").collect()]
    assert order(decision.top_intervals(frame, 3, 5)) == order(decision.top_intervals(frame, 3, 4096))
    steep = spark.createDataFrame([(1, f"t{i:02d}", 2 * (i / 30) - (i / 30) ** 2 - (i / 30) ** 2 + (i / 30) ** 2, (i / 30) ** 2 * -1.0) for i in range(31)], ["radius_m", "component_id", decision.LANDSCAPE, decision.TERRAIN_SCORE])
    assert decision.leader_intervals(decision.top_intervals(steep, 1, 4)).count() == decision.leader_intervals(decision.top_intervals(steep, 1)).count() > 10


def test_keyed_permutation(spark):
    for n in (1, 2, 3, 7, 100, 5003):
        got = [r[0] for r in spark.range(n).select(keyed.permuted(F.col("id"), F.lit(n).cast("bigint"), "p")).collect()]
        assert sorted(got) == list(range(n))
    assert sum(i == v for i, v in enumerate(got)) < 20
    df = spark.range(500).select("id", (F.col("id") % 7).alias("y"), F.lit("kept").alias("z"))
    mixed = benchmark.shuffled(df, "y", "s")
    assert mixed.columns == df.columns and mixed.groupBy("y").count().exceptAll(df.groupBy("y").count()).isEmpty() and mixed.select("id").distinct().count() == 500


def test_stratified_folds(spark):
    rows = [(b, (b * b + i) % 5 if b % 4 else 3, 1) for b in range(80) for i in range(3 + b % 11)]
    df = spark.createDataFrame(rows, "block long, y long, n long")
    for chunk in (1 << 16, 30):
        dealt = sampling.stratified_folds(df, "y", "block", 5, chunk=chunk)
        assert dealt.count() == dealt.select("block").distinct().count() == 80
        counts = df.join(dealt, "block").groupBy("y", "fold").count().groupBy("y").pivot("fold").sum("count").na.fill(0).collect()
        largest = df.groupBy("block", "y").count().agg(F.max("count")).first()[0]
        chunks = -(-80 // chunk)
        assert all(max(r[1:]) - min(r[1:]) <= 2 * largest * chunks for r in counts)


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("fold"))
    seen = benchmark.out_of_fold(df, "fold", 4, lambda train: {r["fold"] for r in train.select("fold").distinct().collect()},
                                 lambda folds, rows: rows.withColumn("seen", F.col("fold").isin(*folds)))
    assert seen.count() == 100 and seen.where("seen").isEmpty()


def test_numbering_without_one_task(spark):
    """Dense places and running sums by ranges; no window or sort of all rows in one partition."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(2).alias("w"), F.lit("x").alias("kept")).repartition(6)
    out = numbered(df, [F.col("v").desc()], "place", {"total": "w", "share": F.lit(0.5)})
    rows = out.orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(5000)) and [r["v"] for r in rows] == sorted((r["v"] for r in rows), reverse=True)
    assert all(r["total"] == 2 * (i + 1) and r["share"] == (i + 1) / 2 for i, r in enumerate(rows)) and out.columns == ["v", "w", "kept", "place", "total", "share"]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), ["v"], "place").collect() == []
    points = spark.createDataFrame([(i, 33.0 + i % 3, 72.0) for i in range(30)], "k int, latitude double, longitude double")
    cells = spatial.weather_cells(points, "k")
    assert "SinglePartition" not in cells._jdf.queryExecution().executedPlan().toString() and cells.select("weather_cell_id").distinct().count() == 3
    predicted = spark.range(200).select(F.lit("m").alias("model"), (F.col("id") % 20).alias("block"), (F.col("id") % 3).alias("y"), (F.col("id") % 2).alias("prediction"))
    assert metrics.block_draws(predicted, 3, 5).count() == 5


def test_quantiles_of_small_and_large_keys(spark):
    rng = random.Random(9)
    rows = [(k, rng.randint(0, 2), rng.gauss(0, 100)) for k, n in (("hot", 900), ("a", 30), ("b", 1), (None, 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, g int, v double")
    ways = []

    def summarise(part, bounded):
        ways.append(bounded)
        return quantiles_wide(part, ["k", "g"], {"v": "v"}, {"q": 0.3}, bounded=bounded)

    got = {(r["k"], r["g"]): (r["v_q"], r["v_n"]) for r in by_size(df, "k", summarise, 100).collect()}
    groups = {(k, g) for k, g, _ in rows}
    assert ways == [True, False] and set(got) == groups
    for key in groups:
        data = [v for k, g, v in rows if (k, g) == key]
        assert got[key] == (pytest.approx(np.quantile(data, 0.3), rel=1e-12), len(data))


def test_sides_that_grow_with_rows_are_not_broadcast(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("v"))
    for out in (with_ranks(df, ["k"], "v", "r"), with_percentile(df, ["k"], {"p": ("v", True)}, ["id"])):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_disc_join_by_tiles_meets_the_cells_of_every_disc(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-50, 3000), rng.uniform(-3000, 50)) for i in range(40)] + [(41, None, 0.0)]
    at = spark.createDataFrame(points, "component_id long, x double, y double")
    cells = spark.range(100 * 100).select(F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"))
    joined = raster.disc_join(at, cells, [60, 120], 0.0, 0.0, 30.0)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["component_id"], r["radius_m"], r["row"], r["col"]) for r in joined.collect())
    assert got == sorted((i, m, r, c) for i, x, y in points[:-1] for m in (60, 120) for r in range(100) for c in range(100)
                         if ((c + 0.5) * 30 - x) ** 2 + ((-r - 0.5) * 30 - y) ** 2 <= m * m)


def test_keys_with_several_places_pool_them(spark):
    at = spark.createDataFrame([(1, 15.0, -15.0), (1, 2985.0, -15.0), (2, 15.0, -15.0)], "component_id long, x double, y double")
    cells = spark.range(100).select(F.lit(0).alias("row"), F.col("id").alias("col"))
    count = lambda p, tile: raster.disc_join(p, cells, [30], 0.0, 0.0, 30.0).groupBy("component_id", *tile).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in raster.by_place(at, count).collect()) == [(1, 4), (2, 2)]


def test_quantiles_of_overlapping_groups_count_every_row_once(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda: rng.choice([None, math.inf, -math.inf, 0.0, -0.0, rng.gauss(0, 1e3), rng.gauss(0, 1e-7), float(rng.randint(-5, 5)), 10.0 + rng.random()])
    rows = [(rng.choice([0, 1, 2, 5, 1 << 39]), draw(), rng.uniform(900, 1e5)) for _ in range(4000)] + [(7, None, 1.0), (7, None, 2.0), (8, math.nan, 3.0), (8, 1.0, 4.0), (8, 2.0, 9.0)]
    members = [("inner", [0]), ("ring", [0, 1]), ("all", [0, 1, 2, 5, 1 << 39]), (None, [1, 5]), ("empty", [7]), ("nan", [8])]
    wanted = {"v50": ("v", 0.5), "w90": ("w", 0.9), "v0": ("v", 0.0), "w100": ("w", 1.0)}
    asks = lambda g: ["v50", "w90"] if g == "ring" else list(wanted)
    groups = spark.createDataFrame([(c, g, asks(g)) for g, cells in members for c in cells], "cell long, g string, outputs array<string>")
    written = []
    keep = lambda df: written.append(df.cache()) or written[-1]
    monkeypatch.setattr(order, "materialise", keep)
    found = quantiles_of_cells(spark.createDataFrame(rows, "cell long, v double, w double"), {"v": "v", "w": "w"}, groups, ["g"], wanted)
    got = {r["g"]: r.asDict() for r in found.collect()}
    assert set(got) == {g for g, _ in members}
    for g, cells in members:
        for out, (m, p) in wanted.items():
            data = sorted((x for r in rows if r[0] in cells and (x := r[1 + "vw".index(m)]) is not None), key=lambda x: (math.isnan(x), x))
            at = p * (len(data) - 1)
            low, high, t = math.floor(at), math.ceil(at), at - math.floor(at)
            if out not in asks(g) or not data:
                assert got[g][out] is None
            elif math.isfinite(data[low]) and math.isfinite(data[high]):
                assert got[g][out] == pytest.approx(data[low] * (1 - t) + data[high] * t, rel=1e-12, abs=1e-15)
    counted = written[0].agg(F.sum("_w")).first()[0]
    assert counted == sum(x is not None for r in rows for x in r[1:])


def test_score_table_reads_lines_twice_for_all_radii(spark, folder, monkeypatch):
    from siterank.plans import bindings

    seen = []
    monkeypatch.setattr(bindings, "quantiles_of_cells", lambda rows, *rest: seen.append(rows) or quantiles_of_cells(rows, *rest))
    scores, _ = bindings.score_table(spark, folder)
    assert len(seen) == 1 and seen[0].count() == spark.read.parquet(f"{folder}/lineitem.parquet").where("l_quantity <= 50").count()
    assert scores.count() > 0


def test_cells_are_counted_without_arrays_of_measures(spark, monkeypatch):
    plans = []
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.cache()
    monkeypatch.setattr(order, "materialise", keep)
    rows = spark.createDataFrame([(1, 1.0, None), (1, 3.0, 5.0), (2, 8.0, 7.0)], "cell long, v double, w double")
    groups = spark.createDataFrame([(1, "a", ["m", "n"]), (2, "a", ["m", "n"]), (2, "b", ["m"])], "cell long, g string, outputs array<string>")
    found = quantiles_of_cells(rows, {"v": "v", "w": "w"}, groups, ["g"], {"m": ("v", 0.5), "n": ("w", 0.5)})
    assert sorted(map(tuple, found.collect())) == [("a", 3.0, 6.0), ("b", 8.0, None)]
    assert "Generate" not in next(p for p in plans if "count(1)" in p.splitlines()[1])


def test_manifest_streams_large_files(spark, tmp_path):
    import hashlib

    (tmp_path / "in ner").mkdir()
    data = {"a.bin": b"abc", "in ner/b 50%25.bin": random.Random(1).randbytes(5 << 20), "c.bin": b"x" * 1000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = manifest.manifest(spark, str(tmp_path), "*.bin", streamed=1000)
    assert {r["relative_path"]: (r["bytes"], r["sha256"]) for r in found.collect()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}


def test_manifest_of_a_file_beyond_the_binary_reader(spark, tmp_path):
    import hashlib

    size = (1 << 31) + 5
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        digest.update(bytes(min(1 << 24, size - at)))
    row = manifest.manifest(spark, str(tmp_path)).first()
    assert (row["bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_lines_of_the_score_table_meet_their_parts_unsorted(spark, monkeypatch):
    from siterank.plans import bindings

    plans, write = [], bindings.materialise
    monkeypatch.setattr(bindings, "materialise", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    bindings.inventory_summaries(spark, "/root/testdata/sf0.001")
    joins = [p for p in plans if "l_partkey" in p]
    assert joins and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in joins)
