"""Scores, rankings, ablations, baselines and decision-weight analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.operators import decision, scoring
from siterank.operators.agreement import rank_agreement, spearman_interval
from siterank.operators.lineage import materialise
from siterank.operators.order import with_ranks
from siterank.plans.bindings import LAST_EPOCH, ranks_sql, score_sql, score_table
from siterank.plans.registry import query, r, rounded

S = scoring
KEYS = ["component_id", "radius_m", "epoch_id"]
SCORE_COLUMNS = [*S.FACTORS, "surface_cover_pressure", S.LANDSCAPE, S.TERRAIN_SCORE, S.PRIORITY]


def frame(spark, folder):
    scores, small = score_table(spark, folder)
    return S.factor_frame(scores, LAST_EPOCH), small


@query("r1_fixed_scores", f"""WITH {score_sql()}
SELECT component_id, radius_m, epoch_id, {', '.join(f'{r(c, 9)} AS {c}' for c in SCORE_COLUMNS)}, fixed_rank FROM scores""")
def fixed_scores(spark, folder):
    return rounded(score_table(spark, folder)[0].select(*KEYS, *SCORE_COLUMNS, "fixed_rank"), 9)


@query("r1_fixed_scores_by_supplier", f"""WITH {score_sql('l_suppkey')}
SELECT component_id, radius_m, epoch_id, {', '.join(f'{r(c, 9)} AS {c}' for c in SCORE_COLUMNS)}, fixed_rank FROM scores""")
def fixed_scores_by_supplier(spark, folder):
    return rounded(score_table(spark, folder, "l_suppkey")[0].select(*KEYS, *SCORE_COLUMNS, "fixed_rank"), 9)


@query("r4_factor_frame", f"""WITH {score_sql()}
SELECT component_id, radius_m, {', '.join(f'{r(c, 9)} AS {c}' for c in SCORE_COLUMNS)} FROM frame WHERE radius_m = 500""")
def factor_frame(spark, folder):
    return rounded(S.factor_frame(score_table(spark, folder)[0], LAST_EPOCH, 500), 9)


# W1-W3 on the priority score
@query("w1_w2_w3_ranks", f"""WITH {score_sql()}
SELECT component_id, radius_m, epoch_id,
  {r("rank() OVER w + (count(*) OVER (PARTITION BY radius_m, epoch_id, local_priority_score) - 1) / 2e0")} AS average_rank,
  rank() OVER w AS min_rank, row_number() OVER (PARTITION BY radius_m, epoch_id ORDER BY local_priority_score DESC, component_id) AS ordinal_rank
FROM scores WINDOW w AS (PARTITION BY radius_m, epoch_id ORDER BY local_priority_score DESC)""")
def rank_methods(spark, folder):
    scores, small = score_table(spark, folder)
    out = scores.select(*KEYS, S.PRIORITY)
    for method in ("average", "min", "ordinal"):
        out = with_ranks(out, ["radius_m", "epoch_id"], S.PRIORITY, f"{method}_rank", method, tie="component_id", bounded=small)
    return rounded(out.drop(S.PRIORITY))


@query("w9_w10_top_components", f"""WITH {score_sql()}
SELECT component_id, radius_m, {r('local_priority_score', 9)} AS local_priority_score FROM frame
WHERE radius_m = 1000 ORDER BY local_priority_score DESC, component_id LIMIT 10""")
def top_components(spark, folder):
    f = S.factor_frame(score_table(spark, folder)[0], LAST_EPOCH, 1000)
    return rounded(f.select("component_id", "radius_m", S.PRIORITY).orderBy(F.col(S.PRIORITY).desc(), "component_id").limit(10), 9)


PAIR_SQL = """
pairs AS (SELECT radius_m, a.f AS factor_a, b.f AS factor_b, a.v AS x, b.v AS y FROM long a JOIN long b
  USING (radius_m, component_id, epoch_id) WHERE a.i < b.i)"""


def _long_sql(columns, source="scores"):
    parts = " UNION ALL ".join(
        f"SELECT radius_m, component_id, epoch_id, {i} AS i, '{c}' AS f, {c} AS v FROM {source}" for i, c in enumerate(columns))
    return f"long AS ({parts})"


SCREENED = ["ndvi_pressure", "mndwi_pressure", "ndbi_pressure", "surface_cover_pressure", "landscape_pressure_score"]


@query("a28_factor_correlation", f"""WITH {score_sql()}, {_long_sql(SCREENED)}, {PAIR_SQL}
SELECT radius_m, factor_a, factor_b, count(*) AS n, {r('CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END')} AS spearman_rho
FROM ({ranks_sql('pairs', 'radius_m, factor_a, factor_b', 'x', 'y')}) GROUP BY ALL""")
def factor_correlation(spark, folder):
    scores, small = score_table(spark, folder)
    return rounded(S.factor_correlations(scores, SCREENED, bounded=small))


@query("a28_redundancy_screen", f"""WITH {score_sql()}, {_long_sql(SCREENED)}, {PAIR_SQL},
rho AS (SELECT radius_m, factor_a, factor_b, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho
  FROM ({ranks_sql('pairs', 'radius_m, factor_a, factor_b', 'x', 'y')}) GROUP BY ALL)
SELECT radius_m, factor_a, factor_b, n, {r('rho')} AS spearman_rho,
  CASE WHEN factor_a IN ('ndvi_pressure', 'ndbi_pressure') AND factor_b IN ('ndvi_pressure', 'ndbi_pressure')
  THEN 'group_into_surface_cover' ELSE 'exclude_mapped_proxy_keep_for_comparison' END AS decision
FROM rho WHERE abs(rho) >= 0.6""")
def redundancy(spark, folder):
    scores, small = score_table(spark, folder)
    return rounded(S.redundancy_screen(S.factor_correlations(scores, SCREENED, bounded=small), 0.6))


@query("a38_terrain_correlation", f"""WITH {score_sql()}, {_long_sql(list(S.TERRAIN), 'frame')}, {PAIR_SQL}
SELECT radius_m, factor_a, factor_b, count(*) AS n, {r('CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END')} AS spearman_rho
FROM ({ranks_sql('pairs', 'radius_m, factor_a, factor_b', 'x', 'y')}) GROUP BY ALL""")
def terrain_correlation(spark, folder):
    table_, small = frame(spark, folder)
    return rounded(S.factor_correlations(table_, list(S.TERRAIN), bounded=small))


KENDALL_SQL = """
kt AS (SELECT {keys}, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.x = b.x THEN 0 ELSE 1 END) AS px,
    sum(CASE WHEN a.y = b.y THEN 0 ELSE 1 END) AS py FROM kin a JOIN kin b USING ({keys}) WHERE a.id < b.id GROUP BY {keys})"""


def change_sql(label, alternatives, reference, tie="average"):
    """SQL of compare_alternatives over ``frame``."""
    union = " UNION ALL ".join(f"SELECT radius_m, component_id, '{n}' AS {label}, {e} AS score, {reference} AS ref FROM {{src}}" for n, e in alternatives.items())
    if tie == "average":
        rk = lambda v: (f"(rank() OVER (PARTITION BY radius_m, {label} ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY radius_m, {label}, {v}) - 1) / 2e0)")
    else:
        rk = lambda v: f"row_number() OVER (PARTITION BY radius_m, {label} ORDER BY {v} DESC, component_id)"
    null = lambda e: f"CASE WHEN min(y) < max(y) THEN {e} END"
    return f"""
alt AS ({union}),
rk AS (SELECT radius_m, {label}, component_id AS id, {rk('ref')} * 1e0 AS x, {rk('score')} * 1e0 AS y FROM alt),
kin AS (SELECT * FROM rk), {KENDALL_SQL.format(keys='radius_m, ' + label)},
base AS (SELECT radius_m, {label}, {null('corr(x, y)')} AS rho, sum(CASE WHEN x <= 3 AND y <= 3 THEN 1 ELSE 0 END) AS top3_overlap,
    sum(CASE WHEN x <= 5 AND y <= 5 THEN 1 ELSE 0 END) AS top5_overlap, {null('avg(abs(x - y))')} AS mean_absolute_rank_shift,
    {null('max(abs(x - y))')} AS maximum_absolute_rank_shift, {null('sum(CASE WHEN abs(x - y) >= 3 THEN 1 ELSE 0 END)')} AS shifts_ge3,
    CASE WHEN min(y) < max(y) THEN arg_min(id, struct_pack(y := y, id := id)) ELSE 'All components tied' END AS rank_1_component
  FROM rk GROUP BY ALL)
SELECT radius_m, {label}, {r('rho')} AS spearman_rho, {r('CASE WHEN px > 0 AND py > 0 THEN s / sqrt(px * 1e0 * py) END')} AS kendall_tau,
  CAST(top3_overlap AS BIGINT) AS top3_overlap, CAST(top5_overlap AS BIGINT) AS top5_overlap,
  {r('mean_absolute_rank_shift')} AS mean_absolute_rank_shift, {r('maximum_absolute_rank_shift')} AS maximum_absolute_rank_shift,
  CAST(shifts_ge3 AS BIGINT) AS shifts_ge3, rank_1_component FROM base LEFT JOIN kt USING (radius_m, {label})"""


L, T, P, C = "landscape_pressure_score", "terrain_susceptibility_score", "local_priority_score", "climate_extreme_score"
N_, B_, M_, S_, W_, D_ = S.FACTORS


def h(a, b):
    return f"(({a}) + ({b})) / 2e0"


ABLATIONS = {
    "Full hierarchy": P, "Landscape only": L, "Terrain only": T,
    "Without NDVI": h(h(B_, M_), T), "Without NDBI": h(h(N_, M_), T), "Without MNDWI": h(h(N_, B_), T),
    "Without slope": h(L, h(W_, D_)), "Without wetness": h(L, h(S_, D_)), "Without drainage": h(L, h(S_, W_)),
}
LOCAL = {"Full local (landscape + terrain)": h(L, T), "Landscape only": L, "Terrain only": T, "No NDVI": h(h(M_, B_), T),
         "No MNDWI": h("surface_cover_pressure", T), "No NDBI": h(h(M_, N_), T)}
DOMAIN = {
    "Full integrated context": f"({L} + {T} + {C}) / 3e0", "Primary local priority": h(L, T), "Landscape only": L, "Terrain only": T,
    "Climate only": C, "Leave climate out": h(L, T), "Leave landscape out": h(T, C), "Leave terrain out": h(L, C),
    "Leave NDVI out": h(h(M_, B_), T), "Leave MNDWI out": h("surface_cover_pressure", T), "Leave NDBI out": h(h(M_, N_), T),
    "Leave slope out": h(L, h(W_, D_)), "Leave terrain wetness out": h(L, h(S_, D_)), "Leave drainage proximity out": h(L, h(S_, W_)),
}


@query("r5_factor_ablation", f"WITH {score_sql()}, {change_sql('scenario', ABLATIONS, P).replace('{src}', 'frame')}")
def factor_ablation(spark, folder):
    table_, small = frame(spark, folder)
    return rounded(S.compare_alternatives(table_, S.factor_ablations(), F.col(P), "scenario", bounded=small))


@query("r5_local_ablation_ordinal", f"WITH {score_sql()}, {change_sql('scenario', LOCAL, h(L, T), 'ordinal').replace('{src}', 'frame')}")
def local_ablation(spark, folder):
    from siterank.functions.columns import mean_of

    table_, small = frame(spark, folder)
    return rounded(S.compare_alternatives(table_, S.local_ablations(), mean_of([L, T]), "scenario", "ordinal", bounded=small))


# One climate value per epoch: the share of customers orders placed late in the year.
CLIMATE_SQL = f"""
cl AS (SELECT 'E' || CAST(year(o_orderdate) AS VARCHAR) AS epoch_id,
  CAST(sum(CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS {C} FROM orders GROUP BY 1)"""


def climate_epochs(spark, folder):
    from siterank.plans.registry import table

    o = table(spark, folder, "orders")
    return o.groupBy(F.concat(F.lit("E"), F.year("o_orderdate").cast("string")).alias("epoch_id")).agg(
        (F.sum(F.when(F.month("o_orderdate") >= 7, 1).otherwise(0)) / F.count(F.lit(1))).alias(C))


@query("r2_j1_integrated_score", f"""WITH {score_sql()}, {CLIMATE_SQL}
SELECT component_id, radius_m, epoch_id, {r(C, 9)} AS {C}, {r(f'({L} + {T} + {C}) / 3e0', 9)} AS integrated_exposure_score
FROM scores LEFT JOIN cl USING (epoch_id)""")
def integrated(spark, folder):
    out = S.integrated_scores(score_table(spark, folder)[0], climate_epochs(spark, folder))
    return rounded(out.select(*KEYS, C, S.INTEGRATED), 9)


def climate_frame(spark, folder):
    scores, small = score_table(spark, folder)
    return S.factor_frame(S.integrated_scores(scores, climate_epochs(spark, folder)), LAST_EPOCH), small


@query("r5_domain_ablation", f"""WITH {score_sql()}, {CLIMATE_SQL}, cframe AS (SELECT * FROM frame LEFT JOIN cl USING (epoch_id)),
{change_sql('scenario', DOMAIN, f'({L} + {T} + {C}) / 3e0').replace('{src}', 'cframe')}""")
def domain_ablation(spark, folder):
    from siterank.functions.columns import mean_of

    table_, small = climate_frame(spark, folder)
    return rounded(S.compare_alternatives(table_, S.domain_ablations(), mean_of([L, T, C]), "scenario", bounded=small))


# --- R6 ------------------------------------------------------------------------------

_conf = lambda a: " + ".join(f"(1 - corr({a}, {b}))" for b in S.FACTORS if b != a)
CRITIC_SQL = f"""
ci AS (SELECT radius_m, {', '.join(f'stddev_samp({a}) * ({_conf(a)}) AS {a}' for a in S.FACTORS)} FROM frame GROUP BY 1),
cw AS (SELECT radius_m, {', '.join(f'{a} / ({" + ".join(S.FACTORS)}) AS w_{a}' for a in S.FACTORS)} FROM ci)"""
ENTROPY_SQL = f"""
sh AS (SELECT radius_m, component_id, {', '.join(f'{a} - min({a}) OVER (PARTITION BY radius_m) + 1e-12 AS {a}' for a in S.FACTORS)} FROM frame),
pr AS (SELECT radius_m, {', '.join(f'{a} / sum({a}) OVER (PARTITION BY radius_m) AS {a}' for a in S.FACTORS)} FROM sh),
en AS (SELECT radius_m, {', '.join(f'1 + sum({a} * ln({a})) / ln(count(*)) AS {a}' for a in S.FACTORS)} FROM pr GROUP BY 1),
ew AS (SELECT radius_m, {', '.join(f'{a} / ({" + ".join(S.FACTORS)}) AS w_{a}' for a in S.FACTORS)} FROM en)"""


@query("r6_critic_weights", f"WITH {score_sql()}, {CRITIC_SQL} SELECT radius_m, {', '.join(f'{r(f"w_{a}")} AS w_{a}' for a in S.FACTORS)} FROM cw")
def critic(spark, folder):
    return rounded(S.critic_weights(frame(spark, folder)[0]))


@query("r6_entropy_weights", f"WITH {score_sql()}, {ENTROPY_SQL} SELECT radius_m, {', '.join(f'{r(f"w_{a}")} AS w_{a}' for a in S.FACTORS)} FROM ew")
def entropy(spark, folder):
    return rounded(S.entropy_weights(frame(spark, folder)[0]))


_oriented = {"a": "-ndvi_median", "b": "ndbi_median", "c": "-mndwi_median"}


@query("r6_p22_robust_logistic", f"""WITH {score_sql()},
o AS (SELECT radius_m, component_id, {', '.join(f'{e} AS {n}' for n, e in _oriented.items())} FROM frame),
m AS (SELECT radius_m, {', '.join(f'median({n}) AS m{n}' for n in _oriented)} FROM o GROUP BY 1),
d AS (SELECT radius_m, {', '.join(f'median(abs({n} - m{n})) AS d{n}' for n in _oriented)} FROM o JOIN m USING (radius_m) GROUP BY 1)
SELECT radius_m, component_id, {r('(' + ' + '.join(f'1 / (1 + exp(-(({n} - m{n}) / CASE WHEN d{n} > 0 THEN d{n} * 1.4826e0 ELSE 1 END)))' for n in _oriented) + ') / 3e0')} AS robust_score
FROM o JOIN m USING (radius_m) JOIN d USING (radius_m)""")
def robust_logistic(spark, folder):
    scores, small = score_table(spark, folder)
    f = scores.where(F.col("epoch_id") == LAST_EPOCH)
    return rounded(S.robust_logistic(f, {"a": -F.col("ndvi_median"), "b": F.col("ndbi_median"), "c": -F.col("mndwi_median")}, small))


BASE_RULES = {
    "Hierarchical reference": P, "Ungrouped equal-factor mean": f"({' + '.join(S.FACTORS)}) / 6e0", "Landscape only": L, "Terrain only": T,
    "CRITIC weighting": "critic", "Entropy weighting": "entropy",
}
_ws = lambda t: "round(" + " + ".join(f"{t}.w_{a} * f.{a}" for a in S.FACTORS) + ", 12)"


@query("r6_weighting_baselines", f"""WITH {score_sql()}, {CRITIC_SQL}, {ENTROPY_SQL},
bf AS (SELECT f.*, {_ws('cw')} AS critic, {_ws('ew')} AS entropy FROM frame f JOIN cw USING (radius_m) JOIN ew USING (radius_m)),
{change_sql('baseline', BASE_RULES, P).replace('{src}', 'bf')}""")
def weighting_baselines(spark, folder):
    table_, small = frame(spark, folder)
    out = S.baseline_comparison(table_, bounded=small)
    return rounded(out.where(F.col("baseline") != "Oriented first principal component"))


@query("r6_first_component")
def first_component(spark, folder):
    table_, small = frame(spark, folder)
    return rounded(S.first_component(table_, bounded=small))


# --- R7, R8, R9, R11 -----------------------------------------------------------------

FORMULATION_SQL = f"""
rf AS (SELECT *, {', '.join(f"rank() OVER (PARTITION BY radius_m ORDER BY {c}) + (count(*) OVER (PARTITION BY radius_m, {c}) - 1) / 2e0 AS r{i}" for i, c in enumerate(S.TERRAIN))} FROM frame),
rs AS (SELECT radius_m, abs(corr(r0, r1)) AS sw, abs(corr(r0, r2)) AS sd, abs(corr(r1, r2)) AS wd FROM rf GROUP BY 1),
ri AS (SELECT radius_m, 1 / (1 + sw + sd) AS i0, 1 / (1 + sw + wd) AS i1, 1 / (1 + sd + wd) AS i2 FROM rs),
tf AS (SELECT f.*, ({S_} + {W_} + {D_}) / 3e0 AS equal_factors,
    i0 / (i0 + i1 + i2) * {S_} + i1 / (i0 + i1 + i2) * {W_} + i2 / (i0 + i1 + i2) * {D_} AS correlation_adjusted,
    ({S_} + {D_}) / 2e0 AS reduced_slope_drainage FROM frame f JOIN ri USING (radius_m))"""


@query("r7_terrain_formulations", f"""WITH {score_sql()}, {FORMULATION_SQL}
SELECT radius_m, component_id, {', '.join(f'{r(m)} AS {m}' for m in S.TERRAIN_MODELS)} FROM tf""")
def formulations(spark, folder):
    out = S.terrain_formulations(frame(spark, folder)[0], ["radius_m"])
    return rounded(out.select("radius_m", "component_id", *S.TERRAIN_MODELS))


SCENARIO_SQL = f"""
so AS ({' UNION ALL '.join(f"SELECT component_id, radius_m, {L}, '{m}' AS terrain_model, {m} AS terrain FROM tf" for m in S.TERRAIN_MODELS)}),
sx AS (SELECT *, round(landscape_weight * {L} + (1 - landscape_weight) * terrain, 12) AS score FROM so, (VALUES (25e-2), (5e-1), (75e-2)) v(landscape_weight)),
scn AS (SELECT *, row_number() OVER (PARTITION BY radius_m, terrain_model, landscape_weight ORDER BY score DESC, component_id) AS rank FROM sx)"""


@query("r8_j8_structural_scenarios", f"""WITH {score_sql()}, {FORMULATION_SQL}, {SCENARIO_SQL}
SELECT component_id, radius_m, terrain_model, landscape_weight, {r('score')} AS score, rank, rank <= 3 AS top3, rank <= 5 AS top5 FROM scn""")
def scenarios(spark, folder):
    out = S.structural_scenarios(frame(spark, folder)[0])
    return rounded(out.select("component_id", "radius_m", "terrain_model", "landscape_weight", "score", "rank", "top3", "top5"))


STABILITY_SQL = """
stb AS (SELECT component_id, count(*) AS scenarios, median(rank) AS median_rank, min(rank) AS rank_min, max(rank) AS rank_max,
    avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS top3_frequency, avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS top5_frequency FROM scn GROUP BY 1)"""


@query("r8_scenario_stability", f"""WITH {score_sql()}, {FORMULATION_SQL}, {SCENARIO_SQL}, {STABILITY_SQL}
SELECT component_id, scenarios, {r('median_rank')} AS median_rank, rank_min, rank_max, {r('top3_frequency')} AS top3_frequency,
  {r('top5_frequency')} AS top5_frequency, CASE WHEN top3_frequency >= 0.5 THEN 'Tier 1: robust high priority'
  WHEN top5_frequency >= 0.5 THEN 'Tier 2: conditional high priority' ELSE 'Tier 3: routine/uncertain priority' END AS inspection_tier FROM stb""")
def stability(spark, folder):
    return rounded(S.scenario_stability(S.structural_scenarios(frame(spark, folder)[0])))


@query("r9_scale_sensitivity", f"""WITH {score_sql()},
ar AS (SELECT component_id, radius_m, rank() OVER (PARTITION BY radius_m ORDER BY {P} DESC) + (count(*) OVER (PARTITION BY radius_m, {P}) - 1) / 2e0 AS rk FROM frame),
kin AS (SELECT a.radius_m AS radius_a_m, b.radius_m AS radius_b_m, component_id AS id, a.rk AS x, b.rk AS y FROM ar a JOIN ar b USING (component_id)),
{KENDALL_SQL.format(keys='radius_a_m, radius_b_m')}
SELECT radius_a_m, radius_b_m, {r('corr(x, y)')} AS spearman_rho, {r('min(s) / sqrt(min(px) * 1e0 * min(py))')} AS kendall_tau,
  CAST(sum(CASE WHEN x <= 3 AND y <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS top3_overlap, CAST(sum(CASE WHEN x <= 5 AND y <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS top5_overlap,
  {r('avg(abs(x - y))')} AS mean_absolute_rank_shift, {r('max(abs(x - y))')} AS maximum_absolute_rank_shift,
  CAST(sum(CASE WHEN abs(x - y) >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS shifts_ge3, arg_min(id, struct_pack(y := y, id := id)) AS rank_1_component
FROM kin JOIN kt USING (radius_a_m, radius_b_m) GROUP BY ALL""")
def scale(spark, folder):
    table_, small = frame(spark, folder)
    return rounded(S.scale_sensitivity(table_, small))


@query("r11_spearman_interval", f"""WITH {score_sql()},
{_long_sql(list(S.TERRAIN), 'frame')}, {PAIR_SQL},
rho AS (SELECT radius_m, factor_a, factor_b, count(*) AS n, corr(rx, ry) AS rho FROM ({ranks_sql('pairs', 'radius_m, factor_a, factor_b', 'x', 'y')}) GROUP BY ALL),
iv AS (SELECT *, greatest(least(rho, 0.999999e0), -0.999999e0) AS q FROM rho),
ci AS (SELECT *, tanh(atanh(q) - 1.959963984540054e0 * sqrt((1 + q * q / 2) / (n - 3))) AS lo, tanh(atanh(q) + 1.959963984540054e0 * sqrt((1 + q * q / 2) / (n - 3))) AS hi FROM iv)
SELECT radius_m, factor_a, factor_b, {r('rho')} AS spearman_rho, {r('lo')} AS rho_ci_low_95, {r('hi')} AS rho_ci_high_95, lo > 0 OR hi < 0 AS interval_excludes_zero FROM ci""")
def rho_interval(spark, folder):
    table_, small = frame(spark, folder)
    rho = S.factor_correlations(table_, list(S.TERRAIN), bounded=small)
    low, high = spearman_interval(F.col("spearman_rho"), F.col("n"))
    out = rho.select("radius_m", "factor_a", "factor_b", "spearman_rho", low.alias("rho_ci_low_95"), high.alias("rho_ci_high_95"))
    return rounded(out.withColumn("interval_excludes_zero", (F.col("rho_ci_low_95") > 0) | (F.col("rho_ci_high_95") < 0)))


@query("a25_kendall_line_measures", f"""WITH cnt AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount + 0e0 AS y, count(*) AS w FROM lineitem GROUP BY ALL),
tot AS (SELECT a.g, sum(a.w * b.w * CASE WHEN a.x <> b.x AND a.y <> b.y THEN sign(a.x - b.x) * sign(a.y - b.y) ELSE 0 END) / 2 AS s,
  sum(a.w * b.w * CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) / 2 AS px, sum(a.w * b.w * CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) / 2 AS py
  FROM cnt a JOIN cnt b USING (g) GROUP BY 1)
SELECT g AS l_returnflag, n, {r('s', 1)} AS s, {r('s / sqrt(px * 1e0 * py)', 9)} AS tau FROM tot JOIN (SELECT g, CAST(sum(w) AS BIGINT) AS n FROM cnt GROUP BY 1) USING (g)""")
def kendall_lines(spark, folder):
    from siterank.plans.registry import table

    items = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") + 0.0).alias("l_discount"))
    out = rank_agreement(items, ["l_returnflag"], "l_quantity", "l_discount")
    return out.select("l_returnflag", "n", F.round("s", 1).alias("s"), (F.round("tau", 9) + 0.0).alias("tau"))


# --- M6, M8, M13 ---------------------------------------------------------------------

DRAWS, GRID_POINTS = 50_000, 1001
UNIFORM_SQL = lambda stream, *parts: ("(CAST(('0x' || substr(md5('311|" + stream + "|' || " + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
                                      + "), 1, 13)) AS BIGINT) / 4503599627370496e0)")
SUMMARY_SQL = lambda keys: f"""SELECT {keys}, {r('quantile_cont(rank, 0.5)')} AS rank_median, {r('quantile_cont(rank, 0.025)')} AS rank_ci_low_95,
  {r('quantile_cont(rank, 0.975)')} AS rank_ci_high_95, {r('avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END)')} AS probability_top_3,
  {r('avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)')} AS probability_top_5, count(*) AS draws"""


@query("m6_m8_beta_weights", f"""WITH {score_sql()},
d AS (SELECT draw, {UNIFORM_SQL('beta0.5', 'draw')} AS u5, {UNIFORM_SQL('beta1.0', 'draw')} AS u1, {UNIFORM_SQL('beta2.0', 'draw')} AS u2 FROM range({DRAWS}) t(draw)),
wt AS (SELECT draw, 5e-1 AS alpha, pow(sin(u5 * 1.5707963267948966e0), 2) AS w FROM d UNION ALL SELECT draw, 1e0, u1 FROM d
  UNION ALL SELECT draw, 2e0, 5e-1 - sin(asin(1 - u2 * 2) / 3) FROM d),
x AS (SELECT component_id, radius_m, alpha, row_number() OVER (PARTITION BY radius_m, alpha, draw ORDER BY w * {L} + (1 - w) * {T} DESC, component_id) AS rank FROM frame, wt)
{SUMMARY_SQL('radius_m, alpha, component_id')} FROM x GROUP BY ALL""")
def beta_weights(spark, folder):
    draws = decision.beta_weight_ranks(frame(spark, folder)[0], draws=DRAWS)
    return rounded(decision.summarise_ranks(draws, ["radius_m", "alpha", "component_id"]))


E_SQL = lambda i: f"-ln({UNIFORM_SQL(f'dirichlet{i}', 'draw')} + 5e-1 / 4503599627370496e0)"


@query("m6_dirichlet_weights", f"""WITH {score_sql()}, {CLIMATE_SQL}, cframe AS (SELECT * FROM frame LEFT JOIN cl USING (epoch_id)),
d AS (SELECT draw, {E_SQL(0)} AS e0, {E_SQL(1)} AS e1, {E_SQL(2)} AS e2 FROM range({DRAWS}) t(draw)),
x AS (SELECT component_id, radius_m, row_number() OVER (PARTITION BY radius_m, draw ORDER BY (e0 * {L} + e1 * {T} + e2 * {C}) / (e0 + e1 + e2) DESC, component_id) AS rank FROM cframe, d)
{SUMMARY_SQL('radius_m, component_id')} FROM x GROUP BY ALL""")
def dirichlet_weights(spark, folder):
    draws = decision.dirichlet_ranks(climate_frame(spark, folder)[0], draws=DRAWS)
    return rounded(decision.summarise_ranks(draws, ["radius_m", "component_id"]))


BREAKS_SQL = f"""
ln AS (SELECT radius_m, component_id AS id, {T} AS t, {L} - {T} AS m FROM frame),
cx AS (SELECT a.radius_m, (b.t - a.t) / (a.m - b.m) AS w FROM ln a JOIN ln b ON a.radius_m = b.radius_m AND a.id < b.id AND abs(a.m - b.m) > 1e-12),
al AS (SELECT radius_m, w FROM cx WHERE w > 1e-10 AND w < 1 - 1e-10 UNION ALL SELECT DISTINCT radius_m, 0e0 FROM ln UNION ALL SELECT DISTINCT radius_m, 1e0 FROM ln),
mg AS (SELECT * FROM (SELECT *, lag(w) OVER (PARTITION BY radius_m ORDER BY w) AS p FROM al) WHERE p IS NULL OR w - p > 1e-10),
br AS (SELECT * FROM (SELECT radius_m, w AS w_lower, lead(w) OVER (PARTITION BY radius_m ORDER BY w) AS w_upper FROM mg) WHERE w_upper IS NOT NULL),
iv AS (SELECT radius_m, w_lower, w_upper, component_id, row_number() OVER (PARTITION BY radius_m, w_lower
    ORDER BY {T} + (w_lower + w_upper) / 2 * ({L} - {T}) DESC, component_id) AS rank FROM br JOIN frame USING (radius_m))"""


@query("m13_j7_rank_intervals", f"""WITH {score_sql()}, {BREAKS_SQL}
SELECT radius_m, {r('w_lower')} AS w_lower, {r('w_upper')} AS w_upper, component_id, rank, rank <= 3 AS top3 FROM iv""")
def rank_intervals(spark, folder):
    return rounded(decision.rank_intervals(frame(spark, folder)[0]))


@query("m13_leader_intervals", f"""WITH {score_sql()}, {BREAKS_SQL},
ld AS (SELECT *, CASE WHEN component_id IS DISTINCT FROM lag(component_id) OVER (PARTITION BY radius_m ORDER BY w_lower) THEN 1 ELSE 0 END AS nw FROM iv WHERE rank = 1),
g AS (SELECT *, sum(nw) OVER (PARTITION BY radius_m ORDER BY w_lower) AS g FROM ld)
SELECT radius_m, component_id, {r('min(w_lower)')} AS w_lower, {r('max(w_upper)')} AS w_upper FROM g GROUP BY radius_m, component_id, g""")
def leaders(spark, folder):
    return rounded(decision.leader_intervals(decision.top_intervals(frame(spark, folder)[0], 1)))


@query("m13_uniform_top3_mass", f"""WITH {score_sql()}, {BREAKS_SQL}
SELECT radius_m, component_id, {r('sum(CASE WHEN rank <= 3 THEN w_upper - w_lower ELSE 0e0 END)')} AS exact_uniform_top3, {r('sum(w_upper - w_lower)')} AS total_weight_mass
FROM iv GROUP BY ALL""")
def top3_mass(spark, folder):
    lines = materialise(frame(spark, folder)[0])
    return rounded(decision.uniform_top3_mass(decision.top_intervals(lines), lines))


@query("m13_response_grid", f"""WITH {score_sql()}
SELECT radius_m, component_id, {r(f'g / {GRID_POINTS - 1}e0')} AS landscape_weight, row_number() OVER (PARTITION BY radius_m, g ORDER BY {T} + g / {GRID_POINTS - 1}e0 * ({L} - {T}) DESC, component_id) AS rank
FROM frame, range({GRID_POINTS}) t(g)""")
def response_grid(spark, folder):
    return rounded(decision.response_grid(frame(spark, folder)[0], GRID_POINTS))
