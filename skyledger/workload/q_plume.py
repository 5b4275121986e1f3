"""Rasters: masking, pairing, stencils, segmentation, regions, mass and rate."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo
from ..functions import physics as P
from ..functions.numeric import t_upper_tail
from ..operators import components as G
from ..operators import plume, raster, stencil
from ..operators.percentiles import exact_percentiles
from ..session import materialise
from . import fixtures as X
from .q_geo import _BRACKET
from .registry import big, query, rnd

THRESHOLDS = (60.0, 100.0, 150.0, 200.0, 900.0)
CENTRAL = 100.0


def _inside():
    x0 = 53.0 + F.col("scene_id") * 0.5
    return F.col("lon").between(x0 + 0.035, x0 + 0.245) & F.col("lat").between(39.235, 39.465)


def _box(spark, sf):
    """Paired rasters with the plume box, pixel areas and scene state."""
    return X.v_raster(spark, sf).select(
        "*", _inside().alias("inside"), P.pixel_area_m2(F.col("lat"), 0.01, 0.01).alias("area_m2"),
        P.n_air(100000.0 + 10 * F.col("scene_id"), F.lit(300.0)).alias("n_air"),
        (3.0 + F.col("scene_id") % 3).alias("u10"), F.lit(1.7).alias("u10_sigma"))


def _foot(spark, sf, thresholds=THRESHOLDS):
    """Footprint cells: inside the box, both products present, reference above each threshold."""
    return (
        _box(spark, sf).where(F.col("inside") & F.col("own").isNotNull())
        .withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))
        .where(F.col("ref") > F.col("thr")).withColumn("enh", F.col("own")))


def _quant(spark, sf, thresholds=THRESHOLDS):
    return plume.quantify(_foot(spark, sf, thresholds), ["scene_id", "thr"])


def _dense(spark, sf):
    return X.v_raster(spark, sf).select("scene_id", "r", "c", "ny", "nx", "lon", "lat", F.col("own").alias("value"))


# ------------------------------------------------------------------ filters and pairing


@query("p3_bbox_predicate", "v_box", "SELECT scene_id, count(*) AS n, count(*) FILTER (inside) AS n_inside FROM v_box GROUP BY 1")
def p3(spark, sf):
    return _box(spark, sf).groupBy("scene_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("n_inside"))


@query("p4_strong_pixels", "v_box", """
SELECT scene_id, count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL) AS n_finite, count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL AND inside) AS n_finite_box,
count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL AND inside AND (own > 200 OR ref > 200)) AS n_strong FROM v_box GROUP BY 1""")
def p4(spark, sf):
    ok = F.col("own").isNotNull() & F.col("ref").isNotNull()
    strong = (F.col("own") > C.STRONG_PPM_M) | (F.col("ref") > C.STRONG_PPM_M)
    n = lambda cond: F.count(F.when(cond, 1))
    return _box(spark, sf).groupBy("scene_id").agg(
        n(ok).alias("n_finite"), n(ok & F.col("inside")).alias("n_finite_box"), n(ok & F.col("inside") & strong).alias("n_strong"))


@query("p13_footprint_masks", "v_foot", "SELECT scene_id, thr, count(*) AS n_px FROM v_foot GROUP BY ALL")
def p13(spark, sf):
    return _foot(spark, sf).groupBy("scene_id", "thr").agg(F.count("*").alias("n_px"))


@query("p14_wind_regime", "v_box", """
SELECT DISTINCT scene_id, u10, u10 BETWEEN 2 AND 8 AS in_regime, u10 - 2 AS margin_low, 8 - u10 AS margin_high, u10 - 2 < 1 AS near_low FROM v_box""")
def p14(spark, sf):
    s = _box(spark, sf).select("scene_id", "u10").distinct()
    return s.select("scene_id", "u10", P.wind_regime(F.col("u10")).alias("w")).select("scene_id", "u10", "w.*")


@query("j1_orthorectify", "v_glt v_raster v_extent", """
SELECT g.scene_id, g.oy, g.ox, r.own AS value FROM v_glt g JOIN v_extent e USING (scene_id) LEFT JOIN v_raster r ON r.scene_id = g.scene_id AND glt_x <> 0 AND glt_y <> 0
AND r.r = least(glt_y, 48) - 1 AND r.c = least(glt_x, 48) - 1""")
def j1(spark, sf):
    raw = X.v_raster(spark, sf).select("scene_id", F.col("r").alias("line"), F.col("c").alias("xtrack"), F.col("own").alias("value"))
    ext = X.v_extent(spark, sf).select("scene_id", F.col("ny").alias("n_lines"), F.col("nx").alias("n_cols"))
    return raster.orthorectify(raw, X.v_glt(spark, sf), ext)


@query("j2_pair_rasters", "v_raster", """
SELECT scene_id, 'ok' AS status, count(*) AS n, count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL) AS n_both, round(sum(own - ref), 6) AS diff FROM v_raster GROUP BY 1""")
def j2(spark, sf):
    x = X.v_raster(spark, sf)
    pairs = raster.pair_rasters(x.select("scene_id", "r", "c", F.col("own").alias("value")), x.select("scene_id", "r", "c", F.col("ref").alias("value")))
    return pairs.groupBy("scene_id", "status").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("own").isNotNull() & F.col("ref").isNotNull(), 1)).alias("n_both"),
        rnd(F.sum(F.col("own") - F.col("ref"))).alias("diff"))


@query("j3_affine_sample", "v_extent v_raster", """
pt AS (SELECT p_partkey AS point_id, p_partkey % n AS scene_id, 53.0::DOUBLE + (p_partkey % n) * 0.5::DOUBLE + (p_partkey % 53 - 2) * 0.0101::DOUBLE AS lon, 39.5::DOUBLE - (p_partkey % 51 - 1) * 0.0099::DOUBLE AS lat FROM part, (SELECT max(scene_id) + 1 AS n FROM v_extent))
SELECT point_id, p.scene_id, round(r.own, 6) AS value FROM pt p JOIN v_extent e USING (scene_id) LEFT JOIN v_raster r ON r.scene_id = p.scene_id
AND r.c = round_even((lon - lon0) / dlon, 0)::BIGINT AND r.r = round_even((p.lat - lat0) / dlat, 0)::BIGINT""".replace("r.own", "r.own").replace("(lon - lon0)", "(p.lon - lon0)"))
def j3(spark, sf):
    n = X.v_extent(spark, sf).agg(F.max("scene_id") + 1).first()[0] or 1
    p = X.table(spark, sf, "part", ["p_partkey"]).select(
        F.col("p_partkey").alias("point_id"), F.expr(f"p_partkey % {n}").alias("scene_id"),
        F.expr(f"53.0D + (p_partkey % {n}) * 0.5D + (p_partkey % 53 - 2) * 0.0101D").alias("lon"),
        F.expr("39.5D - (p_partkey % 51 - 1) * 0.0099D").alias("lat"))
    aff = X.v_extent(spark, sf).select("scene_id", F.col("lon0").alias("x0"), F.col("dlon").alias("dx"), F.col("lat0").alias("y0"), F.col("dlat").alias("dy"))
    r = X.v_raster(spark, sf).select("scene_id", "r", "c", "own")
    return raster.affine_sample(p, r, aff).select("point_id", "scene_id", rnd("own").alias("value"))


# ------------------------------------------------------------------ statistics


@query("a5_background", "v_bg", "SELECT scene_id, round(bg_mean, 6) AS bg_mean, round(bg_var, 4) AS bg_var, bg_n, status FROM v_bg")
def a5(spark, sf):
    b = plume.background(_dense(spark, sf), ~_inside())
    return b.select("scene_id", rnd("bg_mean").alias("bg_mean"), rnd("bg_var", 4).alias("bg_var"), "bg_n", "status")


@query("a6_region_counts", "v_lab v_extent", """
SELECT scene_id, label, count(*) AS n_cells FROM v_lab GROUP BY ALL UNION ALL SELECT scene_id, 0, 2304 - count(*) FROM v_lab GROUP BY 1""")
def a6(spark, sf):
    return G.region_counts(G.label_regions(X.v_mask(spark, sf)), X.v_extent(spark, sf))


@query("a7_integrated_mass", "v_quant", "SELECT scene_id, thr, round(ime_kg, 6) AS ime_kg FROM v_quant")
def a7(spark, sf):
    return _quant(spark, sf).select("scene_id", "thr", rnd("ime_kg").alias("ime_kg"))


@query("a8_mask_area", "v_quant", "SELECT scene_id, thr, round(area_m2, 2) AS area_m2, round(length_m, 6) AS length_m FROM v_quant")
def a8(spark, sf):
    return _quant(spark, sf).select("scene_id", "thr", rnd("area_m2", 2).alias("area_m2"), rnd("length_m").alias("length_m"))


@query("a9_quantify_plume", "v_quant", """
SELECT scene_id, thr, n_px, round(ime_kg, 6) AS ime_kg, round(u_eff, 6) AS u_eff, round(q_t_h, 6) AS q_t_h, round(wind_total, 6) AS wind_total, 'ok' AS status FROM v_quant""")
def a9(spark, sf):
    return _quant(spark, sf).select("scene_id", "thr", "n_px", rnd("ime_kg").alias("ime_kg"), rnd("u_eff").alias("u_eff"),
                                    rnd("q_t_h").alias("q_t_h"), rnd("wind.total").alias("wind_total"), "status")


@query("a10_centroid", "v_quant", "SELECT scene_id, thr, round(clon, 6) AS lon, round(clat, 6) AS lat FROM v_quant")
def a10(spark, sf):
    return _foot(spark, sf).groupBy("scene_id", "thr").agg(rnd(F.avg("lon")).alias("lon"), rnd(F.avg("lat")).alias("lat"))


@query("a11_agreement", "v_box", """
SELECT scene_id, round(corr(own, ref), 6) AS pearson_full, round(corr(own, ref) FILTER (inside), 6) AS pearson_box,
CASE WHEN count(*) FILTER (inside AND (own > 200 OR ref > 200) AND own IS NOT NULL AND ref IS NOT NULL) > 50 THEN round(corr(own, ref) FILTER (inside AND (own > 200 OR ref > 200)), 6) END AS pearson_strong,
count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL) AS n_full, count(*) FILTER (own IS NOT NULL AND ref IS NOT NULL AND inside) AS n_box FROM v_box GROUP BY 1""")
def a11(spark, sf):
    a = plume.agreement(_box(spark, sf), F.col("inside"))
    return a.select("scene_id", *[rnd(c).alias(c) for c in ("pearson_full", "pearson_box", "pearson_strong")], "n_full", "n_box")


@query("a12_amplitude_bias", "v_quant", """
SELECT scene_id, thr, round(bias_mean, 6) AS bias_mean, round(bias, 6) AS bias_ime, round(q_t_h / bias, 6) AS q_calibrated FROM v_quant""")
def a12(spark, sf):
    b = plume.amplitude_bias(_foot(spark, sf), ["scene_id", "thr"])
    return b.join(_quant(spark, sf), ["scene_id", "thr"]).select(
        "scene_id", "thr", rnd("bias_mean").alias("bias_mean"), rnd("bias_ime").alias("bias_ime"), rnd(F.col("q_t_h") / F.col("bias_ime")).alias("q_calibrated"))


@query("a13_diagnostics", "v_box", """
b AS (SELECT scene_id, avg(own) AS m, stddev_pop(own) AS s, quantile_cont(own, 0.99) AS p99 FROM v_box WHERE NOT inside GROUP BY 1),
f AS (SELECT scene_id, avg(own) AS fm, max(own) AS fx, avg(ref) AS rm, count(*) AS n, corr(own, ref) AS r FROM v_box WHERE inside AND own IS NOT NULL AND ref > 100 GROUP BY 1)
SELECT scene_id, round(m, 6) AS bg_mean, round(s, 6) AS bg_std, round(p99, 6) AS bg_p99, round(fm, 6) AS own_mean, round(fx, 6) AS own_max, round(rm, 6) AS ref_mean, n,
round(fm / greatest(s, 1e-9), 6) AS contrast, CASE WHEN n > 10 THEN round(r, 6) END AS pearson FROM b JOIN f USING (scene_id)""")
def a13(spark, sf):
    x = _box(spark, sf)
    bg = x.where(~F.col("inside"))
    s = bg.groupBy("scene_id").agg(F.avg("own").alias("m"), F.stddev_pop("own").alias("s"))
    p = exact_percentiles(bg, ["scene_id"], F.col("own"), {"p99": 0.99})
    f = _foot(spark, sf, (CENTRAL,)).groupBy("scene_id").agg(
        F.avg("own").alias("fm"), F.max("own").alias("fx"), F.avg("ref").alias("rm"), F.count("*").alias("n"),
        plume.guarded_corr(F.col("own"), F.col("ref"), F.lit(True), 10).alias("r"))
    return s.join(p, "scene_id").join(f, "scene_id").select(
        "scene_id", rnd("m").alias("bg_mean"), rnd("s").alias("bg_std"), rnd("p99").alias("bg_p99"), rnd("fm").alias("own_mean"), rnd("fx").alias("own_max"),
        rnd("rm").alias("ref_mean"), "n", rnd(F.col("fm") / F.greatest("s", F.lit(1e-9))).alias("contrast"), rnd("r").alias("pearson"))


@query("a14_split_statistics", "v_box", """
x AS (SELECT *, CASE WHEN c <= 20 THEN 'ribbon' ELSE 'tail' END AS part FROM v_box WHERE own > 60),
t AS (SELECT scene_id, sum(own) AS total FROM x GROUP BY 1)
SELECT scene_id, part, count(*) AS n, round(avg(own), 6) AS mean, round(median(own), 6) AS median, round(quantile_cont(own, 0.95), 6) AS p95, round(quantile_cont(own, 0.99), 6) AS p99,
round(sum(own) / any_value(total), 6) AS mass_fraction, CASE WHEN count(*) FILTER (ref IS NOT NULL) >= 100 THEN round(corr(own, ref), 6) END AS pearson FROM x JOIN t USING (scene_id) GROUP BY ALL""")
def a14(spark, sf):
    x = _box(spark, sf).where(F.col("own") > 60).withColumn("part", F.when(F.col("c") <= 20, "ribbon").otherwise("tail"))
    t = x.groupBy("scene_id").agg(F.sum("own").alias("total"))
    p = exact_percentiles(x, ["scene_id", "part"], F.col("own"), {"median": 0.5, "p95": 0.95, "p99": 0.99})
    s = x.groupBy("scene_id", "part").agg(F.count("*").alias("n"), F.avg("own").alias("mean"), F.sum("own").alias("s"),
                                          plume.guarded_corr(F.col("own"), F.col("ref"), F.lit(True), 99).alias("r"))
    return s.join(p, ["scene_id", "part"]).join(t, "scene_id").select(
        "scene_id", "part", "n", *[rnd(c).alias(c) for c in ("mean", "median", "p95", "p99")], rnd(F.col("s") / F.col("total")).alias("mass_fraction"), rnd("r").alias("pearson"))


@query("a15_region_integral", "v_box", """
SELECT scene_id, round(sum(own) FILTER (inside), 6) AS sum_before, round(sum(own * 0.8::DOUBLE - 20) FILTER (inside), 6) AS sum_after, count(own) FILTER (inside) AS n,
round((1 - sum(abs(own * 0.8::DOUBLE - 20)) FILTER (inside) / sum(abs(own)) FILTER (inside)) * 100, 6) AS reduction_pct FROM v_box GROUP BY 1""")
def a15(spark, sf):
    x = _box(spark, sf).where("inside and own is not null").select(
        "scene_id", F.explode(F.array(F.struct(F.lit("before").alias("v"), F.col("own").alias("e")),
                                      F.struct(F.lit("after").alias("v"), (F.col("own") * 0.8 - 20).alias("e")))).alias("x")).select("scene_id", "x.*")
    g = x.groupBy("scene_id").pivot("v", ["before", "after"]).agg(F.sum("e").alias("s"), F.sum(F.abs("e")).alias("a"), F.count("e").alias("n"))
    return g.select("scene_id", rnd("before_s").alias("sum_before"), rnd("after_s").alias("sum_after"), F.col("before_n").alias("n"),
                    rnd((1 - F.col("after_a") / F.col("before_a")) * 100).alias("reduction_pct"))


@query("a16_streak_profile", "v_box", """
h AS (SELECT * FROM v_box WHERE inside AND own > 80),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, c) AS rk FROM (SELECT scene_id, c, count(*) AS n FROM h GROUP BY ALL)),
t AS (SELECT scene_id, list(k.c ORDER BY k.rk) AS top_cols, round(sum(n) * 100.0::DOUBLE / any_value(tot), 6) AS top_pct FROM k JOIN (SELECT scene_id, count(*) AS tot FROM h GROUP BY 1) USING (scene_id) WHERE rk <= 5 GROUP BY 1)
SELECT scene_id, count(*) AS n_high, quantile_cont(c::DOUBLE, 0.05) AS p5, quantile_cont(c::DOUBLE, 0.5) AS p50, quantile_cont(c::DOUBLE, 0.95) AS p95, count(DISTINCT c) AS n_cols,
round((trunc(quantile_cont(c::DOUBLE, 0.95)) - trunc(quantile_cont(c::DOUBLE, 0.05))) / 48, 6) AS spread, any_value(top_cols) AS top_cols, any_value(top_pct) AS top_pct FROM h JOIN t USING (scene_id) GROUP BY scene_id""")
def a16(spark, sf):
    h = _box(spark, sf).where(F.col("inside") & (F.col("own") > 80))
    per = h.groupBy("scene_id", "nx", "c").agg(F.count("*").alias("n"))
    # One row per detector column: bounded by the sensor's width.
    tops = per.groupBy("scene_id", "nx").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c"))), 1, 5).alias("top"), F.sum("n").alias("n_high"), F.count("*").alias("n_cols"))
    p = exact_percentiles(h, ["scene_id"], F.col("c"), {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    share = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a - x["m"]) * 100.0 / F.col("n_high")
    return tops.join(p, "scene_id").select(
        "scene_id", "n_high", "p5", "p50", "p95", "n_cols", rnd((F.floor("p95") - F.floor("p5")) / F.col("nx")).alias("spread"),
        F.col("top.c").alias("top_cols"), rnd(share).alias("top_pct"))


PERCENTS = (0.1, 1, 5, 50, 95, 99, 99.9)


def _p(prefix: str, percent: float) -> str:
    return f"{prefix}{percent:g}".replace(".", "_")


_PERCENT_SQL = ", ".join(
    f"round(quantile_cont({value}, {percent / 100:g}), 6) AS {_p(prefix, percent)}"
    for value, prefix in (("own", "p"), ("abs(own)", "abs_p"), ("ref", "ref_p"))
    for percent in PERCENTS
)


@query("a18_distribution", "v_box", f"""
SELECT scene_id, count(own) AS n_own, count(ref) AS n_ref, round(min(own), 6) AS min, round(max(own), 6) AS max, round(avg(own), 6) AS mean, round(min(ref), 6) AS ref_min, round(max(ref), 6) AS ref_max, round(avg(ref), 6) AS ref_mean,
{_PERCENT_SQL}, round(max(abs(own)) / max(abs(ref)), 6) AS ratio_max, round(avg(abs(own)) / avg(abs(ref)), 6) AS ratio_mean,
round(avg(CASE WHEN own > 0 THEN 1 ELSE 0 END) FILTER (ref > 150 AND own IS NOT NULL), 6) AS positive, round(avg(CASE WHEN abs(own - ref) / greatest(abs(ref), 1e-9) < 0.5 THEN 1 ELSE 0 END) FILTER (ref > 150 AND own IS NOT NULL), 6) AS within_half
FROM v_box GROUP BY 1""")
def a18(spark, sf):
    x = materialise(_box(spark, sf).select("scene_id", "own", "ref"), "distribution")
    o, r = F.col("own"), F.col("ref")
    hit = (r > 150) & o.isNotNull()
    s = x.groupBy("scene_id").agg(
        F.count(o).alias("n_own"), F.count(r).alias("n_ref"), F.min(o).alias("min"), F.max(o).alias("max"), F.avg(o).alias("mean"),
        F.min(r).alias("ref_min"), F.max(r).alias("ref_max"), F.avg(r).alias("ref_mean"), (F.max(F.abs(o)) / F.max(F.abs(r))).alias("ratio_max"),
        (F.avg(F.abs(o)) / F.avg(F.abs(r))).alias("ratio_mean"), F.avg(F.when(hit, (o > 0).cast("double"))).alias("positive"),
        F.avg(F.when(hit, (F.abs(o - r) / F.greatest(F.abs(r), F.lit(1e-9)) < 0.5).cast("double"))).alias("within_half"))
    out, names = s, []
    for value, prefix in ((o, "p"), (F.abs(o), "abs_p"), (r, "ref_p")):
        probs = {_p(prefix, q): q / 100 for q in PERCENTS}
        out = out.join(exact_percentiles(x, ["scene_id"], value, probs).drop("n_values"), "scene_id", "left")
        names += list(probs)
    rounded = ["min", "max", "mean", "ref_min", "ref_max", "ref_mean", *names, "ratio_max", "ratio_mean", "positive", "within_half"]
    return out.select("scene_id", "n_own", "n_ref", *[rnd(c).alias(c) for c in rounded])


@query("f20_value_limits", "v_box", """
SELECT scene_id, round(quantile_cont(own, 0.98) FILTER (inside AND own > 60), 6) AS vmax, round(quantile_cont(abs(own - ref), 0.98), 6) AS diff_limit FROM v_box GROUP BY 1""")
def f20(spark, sf):
    x = _box(spark, sf)
    a = exact_percentiles(x.where(F.col("inside") & (F.col("own") > 60)), ["scene_id"], F.col("own"), {"vmax": 0.98})
    b = exact_percentiles(x, ["scene_id"], F.abs(F.col("own") - F.col("ref")), {"diff_limit": 0.98}).drop("n_values")
    return a.join(b, "scene_id").select("scene_id", rnd("vmax").alias("vmax"), rnd("diff_limit").alias("diff_limit"))


# ------------------------------------------------------------------ stencils


@query("w9_neighbourhood", "v_nbr", """SELECT scene_id, r, c, n_local::DOUBLE AS n_local, round(mean_local, 9) AS mean_local, round(var_local, 4) AS var_local FROM v_nbr""")
def w9(spark, sf):
    m = stencil.box_moments(_dense(spark, sf), F.col("value"), 5)
    return m.select("scene_id", "r", "c", "n_local", rnd("mean_local", 9).alias("mean_local"), rnd("var_local", 4).alias("var_local"))


def _cand(spark, sf):
    d = _dense(spark, sf)
    return plume.candidates(d, plume.background(d, ~_inside()))


@query("w10_welch_test", "v_cand v_welch", """
SELECT scene_id, r, c, round(t, 6) AS t_stat, round(df, 4) AS df, round(p, 6) AS p, candidate FROM v_welch JOIN v_cand USING (scene_id, r, c)""")
def w10(spark, sf):
    return _cand(spark, sf).select("scene_id", "r", "c", rnd("t_stat").alias("t_stat"), rnd("df", 4).alias("df"), rnd("p", 6).alias("p"), "candidate")


@query("w11_majority", "v_major", "SELECT scene_id, r, c, majority FROM v_major")
def w11(spark, sf):
    return stencil.median_mask(_cand(spark, sf), F.col("candidate"), 3, "majority").select("scene_id", "r", "c", "majority")


@query("w12_gaussian", "v_smooth", "SELECT scene_id, r, c, round(smoothed, 8) AS smoothed, smoothed > 0.5 AS plume FROM v_smooth")
def w12(spark, sf):
    return plume.smooth_mask(_cand(spark, sf)).select("scene_id", "r", "c", rnd("smoothed", 8).alias("smoothed"), "plume")


@query("w13_mean_filter", "v_box", """
n AS (SELECT a.scene_id, a.r, a.c, sum(coalesce(b.own, 0)) / 25 AS o5 FROM (SELECT scene_id, r, c, least(greatest(r + dr, 0), 47) AS rr, least(greatest(c + dc, 0), 47) AS cc FROM v_box, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)) a
 JOIN v_box b ON b.scene_id = a.scene_id AND b.r = a.rr AND b.c = a.cc GROUP BY ALL),
m AS (SELECT a.scene_id, a.r, a.c, sum(coalesce(b.ref, 0)) / 9 AS r3 FROM (SELECT scene_id, r, c, least(greatest(r + dr, 0), 47) AS rr, least(greatest(c + dc, 0), 47) AS cc FROM v_box, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)) a
 JOIN v_box b ON b.scene_id = a.scene_id AND b.r = a.rr AND b.c = a.cc GROUP BY ALL)
SELECT scene_id, count(*) AS n_blocks, round(corr(o5, r3), 6) AS pearson_blocks, round(avg(o5), 6) AS mean_block FROM n JOIN m USING (scene_id, r, c) WHERE r % 5 = 0 AND c % 5 = 0 GROUP BY 1""")
def w13(spark, sf):
    x = X.v_raster(spark, sf)
    both = stencil.mean_filter(stencil.mean_filter(x, F.col("own"), 5, "o5"), F.col("ref"), 3, "r3")
    return both.where("r % 5 = 0 and c % 5 = 0").groupBy("scene_id").agg(
        F.count("*").alias("n_blocks"), rnd(F.corr("o5", "r3")).alias("pearson_blocks"), rnd(F.avg("o5")).alias("mean_block"))


def _segment(spark, sf):
    return plume.segment(_dense(spark, sf), ~_inside())


@query("w14_segment_plume", "v_seg", "SELECT scene_id, r, c, label FROM v_seg")
def w14(spark, sf):
    return _segment(spark, sf)


# ------------------------------------------------------------------ regions


@query("g1_label_regions", "v_lab", "SELECT scene_id, r, c, label FROM v_lab")
def g1(spark, sf):
    return G.label_regions(X.v_mask(spark, sf))


@query("t7_largest_regions", "v_lab", """
SELECT scene_id, label, n_cells FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n_cells DESC, label) AS rk FROM (SELECT scene_id, label, count(*) AS n_cells FROM v_lab GROUP BY ALL)) WHERE rk <= 10""")
def t7(spark, sf):
    n = G.label_regions(X.v_mask(spark, sf)).groupBy("scene_id", "label").agg(F.count("*").alias("n_cells"))
    rank = F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("n_cells"), "label"))
    return n.withColumn("rank", rank).where("rank <= 10").drop("rank")


@query("g2_label_at_point", "v_lab v_extent", """
pt AS (SELECT scene_id, k AS point_id, lon0 + (k * 7 % 50) * 0.01::DOUBLE + 0.003::DOUBLE AS lon, lat0 - (k * 11 % 50) * 0.01::DOUBLE - 0.002::DOUBLE AS lat, round(((k * 7 % 50) * 0.01::DOUBLE + 0.003::DOUBLE) / 0.01)::BIGINT AS c, round(((k * 11 % 50) * 0.01::DOUBLE + 0.002::DOUBLE) / 0.01)::BIGINT AS r FROM v_extent, (SELECT unnest(range(40)) AS k))
SELECT p.scene_id, point_id, CASE WHEN p.c BETWEEN 0 AND 47 AND p.r BETWEEN 0 AND 47 THEN 'ok' ELSE 'outside' END AS status, CASE WHEN p.c BETWEEN 0 AND 47 AND p.r BETWEEN 0 AND 47 THEN coalesce(label, 0) END AS label
FROM pt p LEFT JOIN v_lab l ON l.scene_id = p.scene_id AND l.r = p.r AND l.c = p.c""")
def g2(spark, sf):
    ext = X.v_extent(spark, sf)
    pts = ext.select("scene_id", "lon0", "lat0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("point_id")).select(
        "scene_id", "point_id", (F.col("lon0") + F.expr("(point_id * 7 % 50) * 0.01D") + 0.003).alias("lon"),
        (F.col("lat0") - F.expr("(point_id * 11 % 50) * 0.01D") - 0.002).alias("lat"))
    return G.label_at(G.label_regions(X.v_mask(spark, sf)), pts, ext)


def _label_cells(spark, sf):
    return G.label_regions(X.v_mask(spark, sf)).join(_box(spark, sf), ["scene_id", "r", "c"])


@query("g3_largest_in_box", "v_lab v_box v_extent", """
n AS (SELECT scene_id, label, count(*) AS n FROM v_lab JOIN v_box USING (scene_id, r, c) WHERE inside GROUP BY ALL),
b AS (SELECT scene_id, arg_min(label, {'a': -n, 'b': label}) AS label, max(n) AS n_inside FROM n GROUP BY 1)
SELECT scene_id, coalesce(label, 0) AS label, coalesce(n_inside, 0) AS n_inside FROM v_extent LEFT JOIN b USING (scene_id)""")
def g3(spark, sf):
    return G.largest_in_box(_label_cells(spark, sf), X.v_extent(spark, sf), F.col("inside"))


@query("g4_largest_cluster_box", "v_labfour v_raster", """
b AS (SELECT scene_id, label, count(*) AS n_cells, min(lon) - 0.005::DOUBLE AS x0, min(lat) - 0.005::DOUBLE AS y0, max(lon) + 0.005::DOUBLE AS x1, max(lat) + 0.005::DOUBLE AS y1 FROM v_labfour JOIN v_raster USING (scene_id, r, c) GROUP BY ALL)
SELECT scene_id, label, n_cells, round(x0, 6) AS min_lon, round(y0, 6) AS min_lat, round(x1, 6) AS max_lon, round(y1, 6) AS max_lat FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n_cells DESC, label) AS rk FROM b) WHERE rk = 1""")
def g4(spark, sf):
    b = G.largest_cluster_box(G.label_regions(X.v_mask(spark, sf), reach=0), X.v_extent(spark, sf))
    return b.select("scene_id", "label", "n_cells", *[rnd(c).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("g5_self_isolation", "v_lab v_box", """
SELECT scene_id, label, count(*) AS n_px, count(*) FILTER (inside AND own IS NOT NULL AND ref > 100) AS n_overlap, round(avg(ref), 6) AS ref_mean,
coalesce(count(*) FILTER (inside AND own IS NOT NULL AND ref > 100) >= 0.3 * count(*) AND avg(ref) > 0, false) AS isolated FROM v_lab JOIN v_box USING (scene_id, r, c) GROUP BY ALL""")
def g5(spark, sf):
    cells = _label_cells(spark, sf).withColumn("in_footprint", F.coalesce(F.col("inside") & F.col("own").isNotNull() & (F.col("ref") > CENTRAL), F.lit(False)))
    return plume.self_isolation(cells).withColumn("ref_mean", rnd("ref_mean"))


@query("g6_brightest_pixel", "v_lab v_box", """
p AS (SELECT scene_id, arg_min({'r': r, 'c': c, 'v': own}, {'a': -own, 'r': r, 'c': c}) AS p FROM v_box WHERE inside AND own IS NOT NULL GROUP BY 1),
n AS (SELECT scene_id, label, count(*) AS n FROM v_lab JOIN v_box USING (scene_id, r, c) WHERE inside GROUP BY ALL),
b AS (SELECT scene_id, arg_min(label, {'a': -n, 'b': label}) AS plume_label FROM n GROUP BY 1)
SELECT p.scene_id, p.p.r AS r, p.p.c AS c, round(p.p.v, 6) AS value, coalesce(l.label, 0) AS label, coalesce(l.label = plume_label, false) AS in_plume FROM p LEFT JOIN v_lab l ON l.scene_id = p.scene_id AND l.r = p.p.r AND l.c = p.p.c LEFT JOIN b ON b.scene_id = p.scene_id""")
def g6(spark, sf):
    labels = G.label_regions(X.v_mask(spark, sf))
    x = _box(spark, sf).where(F.col("inside") & F.col("own").isNotNull())
    peak = x.groupBy("scene_id").agg(F.min_by(F.struct("r", "c", "own"), F.struct((-F.col("own")).alias("a"), "r", "c")).alias("p")).select("scene_id", "p.*")
    best = G.largest_in_box(labels.join(x.select("scene_id", "r", "c", "inside"), ["scene_id", "r", "c"]), X.v_extent(spark, sf), F.col("inside"))
    return peak.join(labels, ["scene_id", "r", "c"], "left").join(best.select("scene_id", F.col("label").alias("plume_label")), "scene_id", "left").select(
        "scene_id", "r", "c", rnd("own").alias("value"), F.coalesce("label", F.lit(0)).cast("bigint").alias("label"),
        F.coalesce((F.col("label") == F.col("plume_label")) & (F.col("plume_label") > 0), F.lit(False)).alias("in_plume"))


@query("g7_outlines", "v_lab", """
SELECT l.scene_id, l.label, count(*) * 4 - sum((SELECT count(*) FROM v_lab q WHERE q.scene_id = l.scene_id AND q.label = l.label AND abs(q.r - l.r) + abs(q.c - l.c) = 1))::BIGINT AS n_edges, count(*)::DOUBLE AS area_cells FROM v_lab l GROUP BY ALL""")
def g7(spark, sf):
    o = G.outlines(G.label_regions(X.v_mask(spark, sf)))
    return o.groupBy("scene_id", "label").agg(
        F.sum(F.size("points") - 1).alias("n_edges"), F.sum(F.when(F.col("is_hole"), -F.col("area_cells")).otherwise(F.col("area_cells"))).alias("area_cells"))


@query("g9_crop_bounds", "v_lab v_raster", """
m AS (SELECT scene_id, min(r) AS r0, max(r) + 1 AS r1, min(c) AS c0, max(c) + 1 AS c1 FROM v_lab WHERE label = 1 GROUP BY 1),
k AS (SELECT scene_id, greatest(0, r0 - trunc((r1 - r0) * 0.6)::BIGINT) AS r0, least(48, r1 + trunc((r1 - r0) * 0.6)::BIGINT) AS r1, greatest(0, c0 - trunc((c1 - c0) * 0.6)::BIGINT) AS c0, least(48, c1 + trunc((c1 - c0) * 0.6)::BIGINT) AS c1 FROM m)
SELECT scene_id, count(*) AS n_px, round(min(lon) - 0.005, 6) AS west, round(max(lon) + 0.005, 6) AS east, round(min(lat) - 0.005, 6) AS south, round(max(lat) + 0.005, 6) AS north FROM v_raster JOIN k USING (scene_id) WHERE r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY 1""")
def g9(spark, sf):
    m = G.label_regions(X.v_mask(spark, sf)).where("label = 1").groupBy("scene_id").agg(
        F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("c").alias("c0"), (F.max("c") + 1).alias("c1"))
    mr, mc = F.floor((F.col("r1") - F.col("r0")) * 0.6), F.floor((F.col("c1") - F.col("c0")) * 0.6)
    x = X.v_raster(spark, sf).join(m, "scene_id")
    keep = (F.col("r") >= F.greatest(F.col("r0") - mr, F.lit(0))) & (F.col("r") < F.least(F.col("r1") + mr, F.col("ny"))) & (
        F.col("c") >= F.greatest(F.col("c0") - mc, F.lit(0))) & (F.col("c") < F.least(F.col("c1") + mc, F.col("nx")))
    return x.where(keep).groupBy("scene_id").agg(
        F.count("*").alias("n_px"), rnd(F.min("lon") - 0.005).alias("west"), rnd(F.max("lon") + 0.005).alias("east"),
        rnd(F.min("lat") - 0.005).alias("south"), rnd(F.max("lat") + 0.005).alias("north"))


# ------------------------------------------------------------------ source point and uncertainty


def _wind(spark, sf):
    return X.v_extent(spark, sf).select("scene_id", (2.0 + F.col("scene_id") % 3).alias("u"), F.lit(-1.5).alias("v"))


_UPWIND = """
f AS (SELECT * FROM v_foot WHERE thr = 100), ce AS (SELECT scene_id, avg(lon) AS clon, avg(lat) AS clat FROM f GROUP BY 1),
pr AS (SELECT f.scene_id, lon, lat, clon, clat, ((lon - clon) * 111319.49::DOUBLE * cos(radians(clat)) * -(2.0::DOUBLE + f.scene_id % 3) + (lat - clat) * 111319.49::DOUBLE * 1.5::DOUBLE) / sqrt((2.0::DOUBLE + f.scene_id % 3) ** 2 + 1.5::DOUBLE ** 2) AS proj FROM f JOIN ce USING (scene_id)),
cu AS (SELECT scene_id, quantile_cont(proj, 0.95) AS cut FROM pr GROUP BY 1),
src AS (SELECT scene_id, clon, clat, avg(lon) AS source_lon, avg(lat) AS source_lat, count(*) AS n_top FROM pr JOIN cu USING (scene_id) WHERE proj >= cut - 1e-4 GROUP BY ALL)
"""


@query("w15_upwind_source", "v_foot", _UPWIND + """
SELECT scene_id, round(source_lon, 6) AS source_lon, round(source_lat, 6) AS source_lat, n_top, round(sqrt(((source_lon - clon) * 111319.49 * cos(radians(clat))) ** 2 + ((source_lat - clat) * 111319.49) ** 2) / 1000, 6) AS dist_km FROM src""")
def w15(spark, sf):
    cells = materialise(_foot(spark, sf, (CENTRAL,)).select("scene_id", "lon", "lat"), "footprint")
    s = plume.upwind_source(cells, _wind(spark, sf))
    return s.select("scene_id", rnd("source_lon").alias("source_lon"), rnd("source_lat").alias("source_lat"), "n_top", rnd("dist_km").alias("dist_km"))


_PLACE_SQL = "ceil((round(lat, 9) - 39.07) / 0.03 - 0.5)::BIGINT % 2 AS cell_i, 0 AS cell_j"
_BANDS_SQL = "(SELECT cell_i % 2 AS cell_i, 0 AS cell_j, ts, avg(u) AS u, avg(v) AS v, 0 AS sp FROM v_weather GROUP BY ALL)"


def _bracket(end: str, points: str) -> str:
    """The bracket join of ``points`` (scene_id, lon, lat) as CTEs whose names begin with ``end``."""
    text = re.sub(r"\b(rq|sm|nb|be|bo|ln|ip|vl)\b", rf"{end}\1", _BRACKET.strip()).replace("v_weather", _BANDS_SQL)
    asked = f"{end}rq AS (SELECT scene_id AS request_id, 1704888900 + 3600 * scene_id AS t, {_PLACE_SQL} FROM ({points})),"
    return asked + text[text.index(f"{end}sm AS") :] + f", {end}w AS (SELECT request_id AS scene_id, u, v, sqrt(u * u + v * v) AS u10 FROM {end}vl WHERE ok AND u * u + v * v > 0)"


@query("w16_source_vs_centroid", "v_foot v_weather", f"""
f AS (SELECT * FROM v_foot WHERE thr = 100), ce AS (SELECT scene_id, avg(lon) AS clon, avg(lat) AS clat FROM f GROUP BY 1),
{_bracket('a', 'SELECT scene_id, clon AS lon, clat AS lat FROM ce')},
pr AS (SELECT f.scene_id, lon, lat, clon, clat, ((lon - clon) * 111319.49::DOUBLE * cos(radians(clat)) * -u - (lat - clat) * 111319.49::DOUBLE * v) / aw.u10 AS proj FROM f JOIN ce USING (scene_id) JOIN aw USING (scene_id)),
cu AS (SELECT scene_id, quantile_cont(proj, 0.95) AS cut FROM pr GROUP BY 1),
src AS (SELECT scene_id, clon, clat, avg(lon) AS source_lon, avg(lat) AS source_lat FROM pr JOIN cu USING (scene_id) WHERE proj >= cut - 1e-4 GROUP BY ALL),
{_bracket('b', 'SELECT scene_id, source_lon AS lon, source_lat AS lat FROM src')},
ms AS (SELECT scene_id, coalesce(sum(enh * 1e-6::DOUBLE * 0.01604::DOUBLE * area_m2), 0) * any_value(n_air) / sqrt(sum(area_m2)) * 3.6::DOUBLE AS m FROM f GROUP BY 1),
q AS (SELECT ms.scene_id, source_lat, sqrt(((source_lon - clon) * 111319.49 * cos(radians(clat))) ** 2 + ((source_lat - clat) * 111319.49) ** 2) / 1000 AS dist_km, aw.u10 AS ua, bw.u10 AS ub,
 m * (ln(aw.u10) + 0.6::DOUBLE) AS qa, m * (ln(bw.u10) + 0.6::DOUBLE) AS qb FROM ms LEFT JOIN aw USING (scene_id) LEFT JOIN src USING (scene_id) LEFT JOIN bw USING (scene_id))
SELECT scene_id, round(dist_km, 6) AS dist_km, round(ua, 6) AS u10_centroid, round(ub, 6) AS u10_source, round(ub - ua, 6) AS delta_u10, round(qa, 6) AS q_centroid, round(qb, 6) AS q_source,
 round(abs(qb - qa) / abs(qa), 6) AS rel_delta, abs(qb - qa) / abs(qa) >= 0.1 AS material, CASE WHEN qa IS NULL THEN 'no wind at centroid' WHEN qb IS NULL THEN 'no wind at source' ELSE 'ok' END AS status FROM q""")
def w16(spark, sf):
    """The weather's even and odd rows lie in turn over narrow bands of every scene; scenes are taken at successive hours."""

    def place(points):
        return points.withColumn("cell_i", raster.nearest_index(F.round("lat", 9), 39.07, 0.03) % 2)

    cells = materialise(_foot(spark, sf, (CENTRAL,)), "footprint")
    when = X.v_extent(spark, sf).select("scene_id", (1704888900 + 3600 * F.col("scene_id")).alias("t"))
    bands = X.v_weather(spark, sf).groupBy((F.col("cell_i") % 2).alias("cell_i"), "ts").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    out = plume.source_wind_check(cells, when, bands, ["cell_i"], place)
    names = ("dist_km", "u10_centroid", "u10_source", "delta_u10", "q_centroid", "q_source", "rel_delta")
    return out.select("scene_id", *[rnd(c).alias(c) for c in names], "material", "status")


def _spread(spark, sf):
    q = _quant(spark, sf)
    central = q.where(F.col("thr") == CENTRAL).select("scene_id", "q_t_h")
    return plume.sweep_spread(q.select("scene_id", F.col("q_t_h").alias("q"), "n_px"), ["scene_id"], "q", "n_px", 5, central)


_SPREAD = """
sw AS (SELECT scene_id, max(q_t_h) FILTER (n_px >= 5) AS hi, min(q_t_h) FILTER (n_px >= 5) AS lo, count(*) FILTER (n_px >= 5) AS n_used FROM v_quant GROUP BY 1),
sp AS (SELECT scene_id, n_used, CASE WHEN n_used >= 2 AND q_t_h > 0 THEN (hi - lo) / q_t_h ELSE 0 END AS spread FROM sw JOIN (SELECT * FROM v_quant WHERE thr = 100) USING (scene_id))
"""


@query("w17_mask_sweep", "v_quant", _SPREAD + "SELECT scene_id, n_used, round(spread, 6) AS spread FROM sp")
def w17(spark, sf):
    return _spread(spark, sf).withColumn("spread", rnd("spread"))


_SWEEP = """
pv AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.05), (2, 0.1)) t(i, level)),
cd AS (SELECT scene_id, i, r, c, coalesce(p < level AND n_local >= 12.5 AND own IS NOT NULL, false) AS candidate FROM v_welch, pv),
mj AS (SELECT a.scene_id, a.i, a.r, a.c, count(*) FILTER (b.candidate) >= 5 AS majority FROM (SELECT scene_id, i, r, c, least(greatest(r + dr, 0), 47) AS rr, least(greatest(c + dc, 0), 47) AS cc
  FROM cd, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)) a JOIN cd b ON b.scene_id = a.scene_id AND b.i = a.i AND b.r = a.rr AND b.c = a.cc GROUP BY ALL),
gs AS (SELECT d, exp(-d * d / 8.0::DOUBLE) / (SELECT sum(exp(-k * k / 8.0::DOUBLE)) FROM (SELECT unnest(range(-8, 9)) AS k)) AS w FROM (SELECT unnest(range(-8, 9)) AS d)),
g1 AS (SELECT a.scene_id, a.i, a.r, a.c, sum(b.majority::INTEGER * w) AS s FROM (SELECT scene_id, i, r, c, w, CASE WHEN c + d < 0 THEN -1 - c - d WHEN c + d > 47 THEN 95 - c - d ELSE c + d END AS cc FROM mj, gs) a
  JOIN mj b ON b.scene_id = a.scene_id AND b.i = a.i AND b.r = a.r AND b.c = a.cc GROUP BY ALL),
g2 AS (SELECT a.scene_id, a.i, a.r, a.c, sum(b.s * w) AS s FROM (SELECT scene_id, i, r, c, w, CASE WHEN r + d < 0 THEN -1 - r - d WHEN r + d > 47 THEN 95 - r - d ELSE r + d END AS rr FROM g1, gs) a
  JOIN g1 b ON b.scene_id = a.scene_id AND b.i = a.i AND b.r = a.rr AND b.c = a.c GROUP BY ALL),
pl AS (SELECT scene_id, i, r * 48 + c AS x, r, c FROM g2 WHERE s > 0.5),
aj AS (SELECT p.scene_id, p.i, p.x, q.x AS y FROM pl p JOIN pl q ON p.scene_id = q.scene_id AND p.i = q.i AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1),
re AS (SELECT scene_id, i, x AS a, x AS b FROM aj UNION SELECT s.scene_id, s.i, s.a, j.y FROM re s JOIN aj j ON j.scene_id = s.scene_id AND j.i = s.i AND j.x = s.b),
lb AS (SELECT scene_id, i, b // 48 AS r, b % 48 AS c, dense_rank() OVER (PARTITION BY scene_id, i ORDER BY root) AS label FROM (SELECT scene_id, i, b, min(a) AS root FROM re GROUP BY ALL)),
bx AS (SELECT lb.*, inside, own, area_m2, n_air, u10 FROM lb JOIN v_box USING (scene_id, r, c)),
be AS (SELECT scene_id, i, label, count(*) AS n FROM bx WHERE inside GROUP BY scene_id, i, label QUALIFY row_number() OVER (PARTITION BY scene_id, i ORDER BY count(*) DESC, label) = 1),
qu AS (SELECT scene_id, i, count(*) AS n_px, CASE WHEN count(*) >= 10 THEN (ln(any_value(u10)) + 0.6::DOUBLE) * (coalesce(sum(own * 1e-6::DOUBLE * 0.01604::DOUBLE * area_m2), 0) * any_value(n_air)) / sqrt(sum(area_m2)) * 3.6::DOUBLE END AS q
  FROM bx JOIN be USING (scene_id, i, label) GROUP BY ALL),
ev AS (SELECT s.scene_id, pv.i, level AS p_value, coalesce(n_px, 0) AS n_px, q FROM (SELECT DISTINCT scene_id FROM v_box) s CROSS JOIN pv LEFT JOIN qu ON qu.scene_id = s.scene_id AND qu.i = pv.i)
SELECT scene_id, p_value, n_px, round(q, 6) AS q_t_h, round(coalesce(CASE WHEN count(q) OVER w >= 2 AND max(q) FILTER (i = 1) OVER w > 0 THEN (max(q) OVER w - min(q) OVER w) / max(q) FILTER (i = 1) OVER w END, 0), 6) AS spread
FROM ev WINDOW w AS (PARTITION BY scene_id)"""


@query("w17_p_value_sweep", "v_welch v_box", _SWEEP)
def w17p(spark, sf):
    facts = _box(spark, sf).select("scene_id", "r", "c", "inside", F.col("own").alias("enh"), "area_m2", "n_air", "u10", "u10_sigma")
    out = plume.p_value_sweep(_dense(spark, sf), ~_inside(), facts)
    return out.select("scene_id", "p_value", "n_px", rnd("q_t_h").alias("q_t_h"), rnd("spread").alias("spread"))


@query("f9_rate_bounds", "v_quant", _SPREAD + """,
t AS (SELECT *, sqrt(wind_total ** 2 + (spread / 2) ** 2) AS s FROM v_quant JOIN sp USING (scene_id) WHERE thr = 100)
SELECT scene_id, round(s, 6) AS sigma, round(q_t_h / bias * (1 - s), 6) AS low, round(q_t_h * (1 + s), 6) AS high FROM t""")
def f9(spark, sf):
    q = _quant(spark, sf, (CENTRAL,))
    b = plume.amplitude_bias(_foot(spark, sf, (CENTRAL,)), ["scene_id"]).select("scene_id", "bias_ime")
    j = q.join(b, "scene_id").join(_spread(spark, sf), "scene_id")
    out = plume.rate_bounds(F.col("q_t_h"), F.col("q_t_h") / F.col("bias_ime"), F.col("wind.total"), F.col("spread"))
    return j.select("scene_id", out.alias("b")).select("scene_id", rnd("b.sigma").alias("sigma"), rnd("b.low").alias("low"), rnd("b.high").alias("high"))
