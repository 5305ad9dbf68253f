"""Sampling, splits, checks, set operations, sources over the given tables, and the MLlib benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions import columns as C
from siterank.functions.keyed import ROUNDS, uniform
from siterank.operators import benchmark, checks, metrics, sampling, scoring, spatial
from siterank.operators.lineage import materialise
from siterank.operators.order import with_percentile
from siterank.plans import bindings as B
from siterank.plans.registry import query, r, rounded, row_count, table
from siterank.plans.resample_queries import PRED_SQL, predictions
from siterank.plans.score_queries import FORMULATION_SQL, SCENARIO_SQL, STABILITY_SQL, UNIFORM_SQL, frame
from siterank.plans.bindings import score_sql
from siterank.sources import manifest

BANDS = C.BANDS
FEATURES = [*BANDS, *C.INDICES]


def samples(spark, folder):
    """Labelled parts: mean reflectance, indices, class and block."""
    width = B.grid_width(spark, folder, "part")
    m = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        *[F.avg(c).alias(n) for n, c in B.dn_columns().items()], (F.sum("l_linenumber") % 6).alias("y"))
    m = m.select("id", "y", *[C.reflectance(b).alias(b) for b in BANDS])
    m = m.withColumns(C.normalised_differences()).withColumns({"row": F.floor(F.col("id") / width), "col": F.col("id") % width})
    # ten by ten blocks over the grid
    height = -(-row_count(spark, folder, "part") // width)
    return m.withColumn("block", (F.floor(F.col("row") * 10 / F.lit(float(height))) * 10 + F.floor(F.col("col") * 10 / F.lit(float(width)))).cast("bigint"))


SAMPLES_SQL = f"""
sa AS (SELECT l_partkey AS id, CAST(sum(l_linenumber) % 6 AS BIGINT) AS y, {', '.join(f'{e} AS {n}' for n, e in (('blue', 'avg(CAST(floor(8000 + l_quantity * 100) AS INTEGER)) * 2.75e-5 + -2e-1'), ('red', 'avg(CAST(round(7500 + l_discount * 100000) AS INTEGER)) * 2.75e-5 + -2e-1')))},
  l_partkey // {B.width_sql('part')} AS row, l_partkey % {B.width_sql('part')} AS col FROM lineitem GROUP BY l_partkey),
sb AS (SELECT *, CAST(floor(row * 10 / CAST((SELECT (count(*) + {B.width_sql('part')} - 1) // {B.width_sql('part')} FROM part) AS DOUBLE)) * 10 + floor(col * 10 / CAST({B.width_sql('part')} AS DOUBLE)) AS BIGINT) AS block FROM sa),
sr AS (SELECT *, CASE WHEN block % 10 IN (3, 4) THEN 'test' WHEN block % 10 IN (2, 5) THEN 'buffer' ELSE 'development' END AS role FROM sb)"""


@query("l14_u4_class_distribution", f"WITH {SAMPLES_SQL} SELECT y, {', '.join(f'''count(*) FILTER (role = '{x}') AS {x}''' for x in ('development', 'buffer', 'test'))} FROM sr GROUP BY 1")
def class_distribution(spark, folder):
    return rounded(benchmark.class_distribution(samples(spark, folder).withColumn("role", C.split_role("block")), "role", "y"))


@query("v5_role_contract", f"""WITH {SAMPLES_SQL} SELECT role, count(*) AS rows, count(DISTINCT block) AS blocks, count(*) FILTER (role <> CASE WHEN id % 5 = 0 THEN 'test' ELSE 'development' END) AS legacy_mismatches FROM sr GROUP BY 1""")
def role_contract(spark, folder):
    legacy = samples(spark, folder).withColumn("legacy", F.when(F.col("id") % 5 == 0, "test").otherwise("development"))
    return rounded(checks.role_contract(legacy, "block", "legacy"))


@query("p23_feature_screen", f"""WITH f AS (SELECT l_quantity AS q, l_discount + 0e0 AS d, l_tax AS t, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_linenumber * 1e0 END AS n FROM lineitem),
l AS (SELECT 'q' AS feature, q AS v FROM f UNION ALL SELECT 'd', d FROM f UNION ALL SELECT 't', t FROM f UNION ALL SELECT 'n', n FROM f)
SELECT feature, count(*) FILTER (v IS NULL) AS missing_count, {r('var_samp(v)')} AS variance, count(DISTINCT v) AS unique_values, count(*) FILTER (v IS NULL) = 0 AND var_samp(v) > 0 AS retained,
  CASE WHEN feature IN ('q', 'd') THEN 'reflectance band' ELSE 'engineered spectral index' END AS scientific_role FROM l GROUP BY 1""")
def feature_screen(spark, folder):
    f = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_discount") + 0.0).alias("d"), F.col("l_tax").alias("t"),
                                                F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber") * 1.0).alias("n"))
    return rounded(benchmark.feature_screen(f, ["q", "d", "t", "n"], ["q", "d"]))


CAP = 150


@query("l1_capped_sample", f"""WITH {SAMPLES_SQL}, u AS (SELECT *, {UNIFORM_SQL('cap', 'id')} AS u FROM sr), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u) AS i FROM u)
SELECT id, y, block FROM k WHERE i <= {CAP}""")
def capped(spark, folder):
    return rounded(sampling.capped_sample(samples(spark, folder).select("id", "y", "block"), "y", ["id"], CAP))


FOLDS = 5
FOLD_SQL = f"""
fc AS (SELECT block, y, count(*) AS n FROM sb GROUP BY 1, 2),
fl AS (SELECT list(y ORDER BY y) AS ys, list(n * 1e0 * n ORDER BY y) AS sq, len(list(y)) AS c FROM (SELECT y, sum(n) AS n FROM fc GROUP BY 1)),
fb AS (SELECT block, v, row_number() OVER (ORDER BY c * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) * list_sum(v) DESC, block) AS i
  FROM (SELECT block, c, list_transform(ys, lambda y: coalesce(m[y], 0)) AS v FROM (SELECT block, map(list(y), list(n)) AS m FROM fc GROUP BY 1), fl)),
fa(i, block, fold, held) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), list_transform(range({FOLDS} * (SELECT c FROM fl)), lambda x: CAST(0 AS BIGINT))
  UNION ALL SELECT i, block, f, list_transform(range(len(held)), lambda x: CAST(held[x + 1] + CASE WHEN x // c = f THEN v[x % c + 1] ELSE 0 END AS BIGINT)) FROM (
    SELECT fb.i, fb.block, held, v, c, list_min(list_transform(range({FOLDS}), lambda f: {{'cost': list_reduce(list_transform(range(c), lambda k: (2 * held[f * c + k + 1] * v[k + 1] + v[k + 1] * v[k + 1]) / sq[k + 1]), lambda a, b: a + b), 'fold': f}}))['fold'] AS f
    FROM fa JOIN fb ON fb.i = fa.i + 1, fl)),
fr AS (SELECT y, fold FROM sb JOIN fa USING (block))"""


@query("l2_outer_split", f"""WITH RECURSIVE {SAMPLES_SQL}, {FOLD_SQL},
gy AS (SELECT fold, max(abs(n * 1e0 / a - 2e-1)) AS gap FROM (SELECT fold, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY y) AS a FROM fr GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT g.fold, count(*) FILTER (f.fold = g.fold) AS test_rows, count(DISTINCT CASE WHEN f.fold = g.fold THEN y END) + count(DISTINCT CASE WHEN f.fold <> g.fold THEN y END) AS completeness,
  abs(count(*) FILTER (f.fold = g.fold) * 1e0 / count(*) - 2e-1) AS p FROM fr f, (SELECT DISTINCT fold FROM fr) g GROUP BY 1)
SELECT fold, test_rows, completeness, {r('p')} AS size_penalty, {r('gap')} AS largest_share_gap, row_number() OVER (ORDER BY completeness DESC, round(p, 12), fold) = 1 AS selected FROM s JOIN gy USING (fold)""")
def outer_split(spark, folder):
    return rounded(sampling.choose_outer_split(samples(spark, folder).select("id", "y", "block"), "y", "block", FOLDS))


@query("l2_stratified_folds", f"WITH RECURSIVE {SAMPLES_SQL}, {FOLD_SQL} SELECT block, fold FROM fa WHERE i > 0")
def folds(spark, folder):
    return sampling.stratified_folds(samples(spark, folder).select("id", "y", "block"), "y", "block", FOLDS)


def spread(spark, folder):
    c = samples(spark, folder).select("row", "col", "y")
    return sampling.spread_sample(c, ["y"], 3, 12), c


@query("l3_spread_sample_weights", f"""WITH {SAMPLES_SQL}, n AS (SELECT y, count(*) AS n FROM sb GROUP BY 1)
SELECT y, least(n, 12) AS sampled, {r('least(n, 12) * 1e0 / n')} AS inclusion_probability, {r('n * 1e0 / least(n, 12)')} AS design_weight, 0 AS close_pairs FROM n""")
def spread_sample(spark, folder):
    s, c = spread(spark, folder)
    weighted = materialise(sampling.design_weights(s, c, ["y"]))
    a = weighted.where("spaced").select("y", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("sequence").alias("s1"))
    b = weighted.where("spaced").select("y", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("sequence").alias("s2"))
    close = a.join(b, "y").where((F.col("s1") < F.col("s2")) & (F.abs(F.col("r1") - F.col("r2")) < 3) & (F.abs(F.col("c1") - F.col("c2")) < 3)).groupBy("y").agg(F.count(F.lit(1)).alias("close_pairs"))
    out = weighted.groupBy("y").agg(F.count(F.lit(1)).alias("sampled"), F.max("inclusion_probability").alias("inclusion_probability"), F.max("design_weight").alias("design_weight"))
    return rounded(out.join(close, "y", "left").na.fill(0, ["close_pairs"]))


# --- checks --------------------------------------------------------------------------

@query("v1_v2_grain_checks", """WITH p AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS k FROM lineitem)
SELECT 'row_count' AS check_id, true AS passed, CAST(n AS DOUBLE) AS observed, CAST(n AS DOUBLE) AS expected FROM p UNION ALL SELECT 'unique_key', n = k, CAST(n - k AS DOUBLE), 0 FROM p
UNION ALL SELECT 'no_null_cells', true, 0, 0 FROM p UNION ALL SELECT 'domain_l_returnflag', true, 1, 1 FROM p""")
def grain(spark, folder):
    items = table(spark, folder, "lineitem")
    out = checks.grain_checks(items, ["l_orderkey", "l_linenumber"], items.count(), {"l_returnflag": ["A", "N", "R"]})
    return out.select("check_id", "passed", "observed", "expected")


@query("a34_table_profile", """WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_key_rows, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM d""")
def profile(spark, folder):
    return checks.table_profile(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a34_key_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, folder):
    return rounded(checks.key_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("v4_grid_alignment", f"""WITH {B.index_cells_sql()}
SELECT epoch_id, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, count(*) AS cells, 0 AS repeated_cells, min(row) >= 0 AND max(row) < {B.width_sql('part')} AND min(col) >= 0 AND max(col) < {B.width_sql('part')} AS aligned FROM cells GROUP BY 1""")
def alignment(spark, folder):
    w = B.grid_width(spark, folder, "part")
    return rounded(checks.grid_alignment(B.index_cells(spark, folder), w, w, ["epoch_id"]))


@query("v6_probability_checks", f"""WITH {PRED_SQL}, q AS (SELECT model, id, sum(p) AS s, min(p) AS lo, max(p) AS hi, min(y) AS y FROM pr GROUP BY 1, 2)
SELECT model, count(*) AS rows, count(*) FILTER (lo < 0 OR hi > 1) AS outside_unit_interval, count(*) FILTER (abs(s - 1) > 1e-6) AS not_summing_to_one, count(*) FILTER (y NOT BETWEEN 0 AND 9) AS class_outside_domain FROM q GROUP BY 1""")
def probability_checks(spark, folder):
    return checks.probability_checks(predictions(spark, folder), 10)


SCORE_COLUMNS = [*scoring.FACTORS, scoring.LANDSCAPE, scoring.TERRAIN_SCORE, scoring.PRIORITY]


@query("v7_score_bounds", f"WITH {score_sql()} " + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} NOT BETWEEN 0 AND 1) AS outside FROM frame' for c in SCORE_COLUMNS))
def score_bounds(spark, folder):
    return checks.bounds(frame(spark, folder)[0], SCORE_COLUMNS)


@query("v9_secret_scan", """WITH h AS (SELECT doc_id, [CASE WHEN regexp_matches(text, '(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,})') THEN 'GitHub token' END, CASE WHEN regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{20,}\\b') THEN 'OpenAI key' END,
  CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'AWS access key' END, CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private key' END] AS l FROM documents)
SELECT doc_id, pattern FROM (SELECT doc_id, unnest(l) AS pattern FROM h) q WHERE pattern IS NOT NULL""")
def secrets(spark, folder):
    return checks.secret_scan(table(spark, folder, "documents"), ["doc_id"], "text")


@query("v10_interval_checks", f"""WITH b AS (SELECT l_returnflag AS g, l_discount * 12 AS p, CASE WHEN l_quantity > 2 THEN l_tax END AS lo, l_discount AS hi FROM lineitem)
SELECT g, count(*) FILTER (p NOT BETWEEN 0 AND 1) AS p_outside, count(*) FILTER (lo IS NULL OR hi IS NULL) AS interval_missing, count(*) FILTER (lo > hi) AS interval_reversed FROM b GROUP BY 1""")
def interval_checks(spark, folder):
    b = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") * 12).alias("p"), F.when(F.col("l_quantity") > 2, F.col("l_tax")).alias("lo"), F.col("l_discount").alias("hi"))
    return checks.interval_checks(b, "p", "lo", "hi", ["g"])


@query("j16_v8_r14_reproduction", f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS p, round(l_extendedprice / l_quantity, 2) * l_quantity AS f FROM lineitem)
SELECT 'price' AS metric, count(*) AS rows, {r('max(abs(p - f))', 4)} AS max_abs_difference, {r('avg(abs(p - f))', 4)} AS mean_abs_difference, max(abs(p - f)) <= 2e-1 AS pass FROM
 (SELECT x.p, y.f FROM a x JOIN a y USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))""")
def reproduction(spark, folder):
    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = table(spark, folder, "lineitem")
    new = items.select(*k, F.col("l_extendedprice").alias("price"))
    old = items.select(*k, (F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2) * F.col("l_quantity")).alias("price"))
    return rounded(checks.reproduction(new, old, k, ["price"], 0.2), 4)


@query("r12_tier_intervals")
def tiers(spark, folder):
    s = scoring.scenario_stability(scoring.structural_scenarios(frame(spark, folder)[0]))
    return rounded(checks.tier_intervals(s))


@query("a42_evidence_cross_check", f"""WITH {score_sql()}, e AS (SELECT DISTINCT p_brand AS component_id FROM part UNION ALL SELECT 'Brand#unranked'),
k AS (SELECT component_id, fixed_rank AS rank, local_priority_score AS s FROM frame WHERE radius_m = 500)
SELECT component_id, rank, {r('s')} AS local_priority_score, coalesce(rank <= 5, false) AS in_core_tier FROM e LEFT JOIN k USING (component_id)""")
def evidence(spark, folder):
    scores, _ = B.score_table(spark, folder)
    ranks = scores.where((F.col("epoch_id") == B.LAST_EPOCH) & (F.col("radius_m") == 500)).select("component_id", F.col("fixed_rank").alias("rank"), scoring.PRIORITY)
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("component_id")).distinct()
    extra = brands.limit(1).select(F.lit("Brand#unranked").alias("component_id"))
    return rounded(checks.evidence_cross_check(brands.unionByName(extra), ranks, "component_id"))


SHARE_SQL = lambda k: f"count(*) FILTER (l_linenumber = {k}) * 1e0 / count(*)"


def _pct(v, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) - 1 + count(*) OVER (PARTITION BY {part}, {v}) / 2e0) / count(*) OVER (PARTITION BY {part})"


@query("r3_w4_comparison_pressures", f"""WITH s AS (SELECT l_suppkey AS component_id, 'E' || CAST(year(l_shipdate) AS VARCHAR) AS epoch_id, l_returnflag AS radius, {SHARE_SQL(1)} AS built, {SHARE_SQL(2)} AS bare FROM lineitem GROUP BY 1, 2, 3)
SELECT component_id, epoch_id, radius, {r(_pct('built', 'radius'), 9)} AS built_share_pressure, {r(_pct('bare', 'radius'), 9)} AS bare_share_pressure FROM s""")
def comparison_pressures(spark, folder):
    """The bucketed percentile path over a population that grows with the suppliers."""
    share = lambda k: F.count_if(F.col("l_linenumber") == k) / F.count(F.lit(1))
    s = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("component_id"), F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("epoch_id"),
                                                F.col("l_returnflag").alias("radius")).agg(share(1).alias("built"), share(2).alias("bare"))
    out = with_percentile(materialise(s), ["radius"], {"built_share_pressure": ("built", True), "bare_share_pressure": ("bare", True)}, ["component_id", "epoch_id"], bounded=False)
    return rounded(out.drop("built", "bare"), 9)


# --- joins and set operations --------------------------------------------------------

@query("j11_u2_block_intersection", f"WITH {SAMPLES_SQL} SELECT count(*) AS overlap FROM (SELECT DISTINCT block FROM sr WHERE role = 'development' INTERSECT SELECT DISTINCT block FROM sr WHERE role = 'test')")
def block_intersection(spark, folder):
    s = samples(spark, folder).withColumn("role", C.split_role("block"))
    return s.where(F.col("role") == "development").select("block").intersect(s.where(F.col("role") == "test").select("block")).agg(F.count(F.lit(1)).alias("overlap"))


@query("j15_sample_gather", f"""WITH {B.index_cells_sql()}, {SAMPLES_SQL} SELECT s.id, s.y, {r('v.ndvi', 9)} AS ndvi, {r('v.mndwi', 9)} AS mndwi FROM sr s JOIN vcells v ON v.row = s.row AND v.col = s.col AND v.epoch_id = 'E2001'""")
def gather(spark, folder):
    cells = B.index_cells(spark, folder).where(C.valid_cell() & (F.col("epoch_id") == "E2001")).select("row", "col", "ndvi", "mndwi")
    return rounded(samples(spark, folder).select("id", "y", "row", "col").join(cells, ["row", "col"]).select("id", "y", "ndvi", "mndwi"), 9)


@query("u1_u4_union_melt", f"""WITH u AS (SELECT 'lineitem' AS part, l_suppkey AS k, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 2 UNION ALL SELECT 'orders', o_custkey, count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 2)
SELECT part, k, 'n' AS measure, CAST(n AS BIGINT) AS v FROM u UNION ALL SELECT part, k, 'q', CAST(q AS BIGINT) FROM u""")
def union_melt(spark, folder):
    a = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q")).withColumn("part", F.lit("lineitem"))
    b = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("q")).withColumn("part", F.lit("orders"))
    return a.unionByName(b).unpivot(["part", "k"], ["n", "q"], "measure", "v")


@query("w8_topk_membership", f"""WITH {score_sql()}, k AS (SELECT radius_m, component_id, row_number() OVER (PARTITION BY radius_m ORDER BY landscape_pressure_score DESC, component_id) AS a, row_number() OVER (PARTITION BY radius_m ORDER BY terrain_susceptibility_score DESC, component_id) AS b FROM frame)
SELECT radius_m, count(*) FILTER (a <= 3 AND b <= 3) AS top3_overlap, count(*) FILTER (a <= 5 AND b <= 5) AS top5_overlap FROM k GROUP BY 1""")
def topk(spark, folder):
    from siterank.operators.order import inventory_rank

    f, _ = frame(spark, folder)
    k = f.select("radius_m", inventory_rank(["radius_m"], scoring.LANDSCAPE, "ordinal", "component_id").alias("a"), inventory_rank(["radius_m"], scoring.TERRAIN_SCORE, "ordinal", "component_id").alias("b"))
    return k.groupBy("radius_m").agg(*[F.count_if((F.col("a") <= n) & (F.col("b") <= n)).alias(f"top{n}_overlap") for n in (3, 5)])


EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("s3_map_json_pivot", f"""WITH e AS (SELECT CAST(ts AS DATE) AS date, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT date, {', '.join(f"max(k) FILTER (event_type = '{t}') AS {t}" for t in EVENTS)}, count(*) AS n FROM e GROUP BY 1""")
def map_json(spark, folder):
    e = table(spark, folder, "events").select(F.to_date("ts").alias("date"), "event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "k"))
    hit = lambda t: F.max(F.when(F.col("event_type") == t, F.col("k"))).alias(t)
    return e.where(F.col("key") == "k").groupBy("date").agg(*[hit(t) for t in EVENTS], F.count(F.lit(1)).alias("n"))


@query("s10_table_manifest")
def table_manifest(spark, folder):
    return manifest.manifest(spark, folder, "*.parquet")


@query("s12_url_inventory", """WITH p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://', '') AS relative_path FROM pages), s AS (SELECT page_id, relative_path, lower(regexp_extract(relative_path, '[^/](\\.[^./]+)$', 1)) AS x FROM p)
SELECT page_id, CASE WHEN x = '' THEN 'none' ELSE x END AS file_type, CASE WHEN x IN ('.py', '.r', '.mjs', '.js', '.sh') THEN 'executable_code' WHEN x IN ('.tif', '.tiff', '.hgt', '.gz') THEN 'spatial_data' WHEN x IN ('.geojson', '.gpkg') THEN 'vector_data'
  WHEN x IN ('.csv', '.xlsx') THEN 'tabular_data_or_result' WHEN x IN ('.docx', '.pdf', '.md', '.txt') THEN 'documentation' ELSE 'other' END AS workflow_role FROM s""")
def url_inventory(spark, folder):
    p = table(spark, folder, "pages").select("page_id", F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^https?://", "").alias("relative_path"))
    return manifest.classify_files(p).select("page_id", "file_type", "workflow_role")


@query("p13_footprint_coverage", """WITH n AS (SELECT n_nationkey, n_nationkey % 5 * 400e0 + 293100e0 AS bx, 3748500e0 - n_nationkey // 5 * 150e0 AS b2 FROM nation)
SELECT n_nationkey, bool_and((x BETWEEN bx AND bx + 120 AND y BETWEEN b2 - 120 AND b2 AND NOT (x BETWEEN bx + 30 AND bx + 75 AND y BETWEEN b2 - 75 AND b2 - 30)) OR (x BETWEEN bx + 150 AND bx + 210 AND y BETWEEN b2 - 60 AND b2)) AS full_coverage
FROM n, (VALUES (293105e0), (293125e0)) c(x), (VALUES (3748480e0), (3748495e0)) d(y) GROUP BY 1""")
def footprint(spark, folder):
    from siterank.plans.raster_queries import footprints

    return rounded(spatial.covers_box(footprints(spark, folder), (293105.0, 3748480.0, 293125.0, 3748495.0), ["n_nationkey"], 60.0))


# --- benchmark -----------------------------------------------------------------------

CLASSES = 6


def split(spark, folder):
    s = materialise(samples(spark, folder).select("id", "block", "y", *FEATURES, "row", "col").withColumn("role", C.split_role("block")))
    return s.where(F.col("role") == "development"), s.where(F.col("role") == "test")


def scored(predictions_):
    p = metrics.with_prediction(predictions_)
    return metrics.summary(metrics.confusion(p), CLASSES).join(metrics.probability_losses(p), "model")


@query("l4_l5_model_selection")
def model_selection(spark, folder):
    """Inner buffered search per family, then the refitted models on the test stripe."""
    dev, test = split(spark, folder)
    build = benchmark.families(FEATURES, CLASSES)
    grids = {"logistic": [{"regularisation": 0.01}, {"regularisation": 0.1}], "forest": [{"min_leaf": 5, "depth": 5, "trees": 20}]}
    parts = []
    for name, grid in grids.items():
        best, inner = benchmark.search(dev, build[name], grid, CLASSES, [(0, 4), (5, 9)])
        model = build[name](**best).fit(benchmark.balanced(dev))
        parts.append(scored(benchmark.probabilities(model, test, CLASSES, name)).withColumn("inner_macro_f1", F.lit(inner)))
    return rounded(parts[0].unionByName(parts[1]), 4)


@query("l13_controls")
def controls(spark, folder):
    dev, test = split(spark, folder)
    parts = [benchmark.class_prior(dev, test, CLASSES)]
    for name, columns in (("bands-only", BANDS), ("indices-only", C.INDICES), ("location-only", ["row", "col"])):
        model = benchmark.families(columns, CLASSES)["logistic"]().fit(benchmark.balanced(dev))
        parts.append(benchmark.probabilities(model, test, CLASSES, name))
    mixed = benchmark.families(FEATURES, CLASSES)["logistic"]().fit(benchmark.balanced(benchmark.shuffled(dev, "y", "labels")))
    parts.append(benchmark.probabilities(mixed, test, CLASSES, "shuffled-labels"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(scored(out), 4)


def _deal_sql(v: str) -> str:
    """One pass of the keyed permutation over the number ``v``."""
    l, rr = f"({v} % a)", f"({v} // a)"
    for k in range(ROUNDS):
        mixed = lambda other, size: f"CAST(floor({UNIFORM_SQL('labels', str(k), other)} * {size}) AS BIGINT)"
        if k % 2 == 0:
            l = f"(({l} + {mixed(rr, 'a')}) % a)"
        else:
            rr = f"(({rr} + {mixed(l, 'b')}) % b)"
    return f"({rr} * a + {l})"


@query("l13_shuffled_labels", f"""WITH RECURSIVE {SAMPLES_SQL}, nn AS (SELECT *, CAST(ceil(n * 1e0 / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM sb)),
ix AS (SELECT id, y, row_number() OVER (ORDER BY id) - 1 AS i FROM sb),
wk(id, v, step) AS (SELECT id, {_deal_sql('i')}, 1 FROM ix, nn UNION ALL SELECT id, {_deal_sql('v')}, step + 1 FROM wk, nn WHERE v >= n)
SELECT wk.id, g.y FROM wk JOIN ix g ON g.i = wk.v, nn WHERE v < n""")
def shuffled_labels(spark, folder):
    return benchmark.shuffled(samples(spark, folder).select("id", "y"), "y", "labels")


def forest(spark, folder, seed=311):
    dev, test = split(spark, folder)
    return benchmark.families(FEATURES, CLASSES, seed)["forest"](5, 5, 20).fit(benchmark.balanced(dev)), test


@query("l15_impurity_importance")
def impurity(spark, folder):
    return rounded(benchmark.impurity_importance(forest(spark, folder)[0], FEATURES), 4)


@query("l12_permutation_importance")
def permutation(spark, folder):
    model, test = forest(spark, folder)
    return rounded(benchmark.permutation_importance(model, test, FEATURES[:3], CLASSES, repeats=2), 4)


@query("m16_seed_sensitivity")
def seeds(spark, folder):
    parts = []
    for seed in (311, 733, 2026):
        model, test = forest(spark, folder, seed)
        parts.append(scored(benchmark.probabilities(model, test, CLASSES, f"forest-{seed}")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)
