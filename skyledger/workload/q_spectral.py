"""Spectra: band choice, matched filter, shrinkage, responses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import physics as P
from ..operators import spectral as M
from ..operators.percentiles import exact_percentiles
from ..session import materialise
from . import fixtures as X
from .registry import query, rnd

TWO = ((2150.0, 2150.0), (2200.0, 2200.0))

_TWO_SQL = """
g AS (SELECT scene_id, xtrack, line, rad[13] AS x1, rad[17] AS x2, bad FROM v_pixels),
m AS (SELECT scene_id, xtrack, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS a, var_samp(x2) AS d, covar_samp(x1, x2) * (1 - 1e-9::DOUBLE) AS b FROM g WHERE NOT bad GROUP BY ALL),
s AS (SELECT *, -(1.0::DOUBLE + 84 % 5) / 1000 * m1 AS s1, -(1.0::DOUBLE + 112 % 5) / 1000 * m2 AS s2, a * d - b * b AS det FROM m),
z AS (SELECT *, (d * s1 - b * s2) / det AS z1, (a * s2 - b * s1) / det AS z2 FROM s)
"""


@query("p1_select_bands", "v_bands", """
SELECT scene_id, list(band ORDER BY band) AS kept_bands, list(wl ORDER BY band) AS kept_wl, 'ok' AS status FROM v_bands WHERE wl BETWEEN 2137 AND 2493 OR wl BETWEEN 2000 AND 2050 GROUP BY 1""")
def p1(spark, sf):
    return M.select_bands(X.v_bands(spark, sf), (*C.CH4_WINDOWS_NM, (2000.0, 2050.0))).select("scene_id", "kept_bands", "kept_wl", "status")


@query("p2_bad_pixels", "v_pixels", """
SELECT scene_id, xtrack, count(*) AS n, count(*) FILTER (flags[5] <> 0) AS n_aggregate, count(*) FILTER (flags[1] <> 0 OR flags[2] <> 0 OR flags[3] <> 0 OR flags[4] <> 0) AS n_any FROM v_pixels GROUP BY ALL""")
def p2(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    return X.v_pixels(spark, sf).groupBy("scene_id", "xtrack").agg(
        F.count("*").alias("n"), n(M.bad_pixels(F.col("flags"))).alias("n_aggregate"), n(M.bad_pixels(F.col("flags"), False)).alias("n_any"))


def _good(spark, sf, windows):
    sel = M.select_bands(X.v_bands(spark, sf), windows)
    proj = M.project_bands(X.v_pixels(spark, sf), sel)
    return sel, proj, M.good_pixels(proj)


@query("a2_target_signature", "v_pixels v_bands", """
m AS (SELECT p.scene_id, xtrack, b.band, any_value(k) * avg(rad[b.band + 1]) AS s FROM v_pixels p JOIN v_bands b ON b.scene_id = p.scene_id AND wl BETWEEN 2137 AND 2493 WHERE NOT bad GROUP BY ALL)
SELECT scene_id, xtrack, band, round(s, 9) AS target FROM m""")
def a2(spark, sf):
    sel, _, good = _good(spark, sf, C.CH4_WINDOWS_NM)
    m = M.column_moments(good).join(sel.select("scene_id", "kept_bands", "kept_k"), "scene_id")
    s = F.arrays_zip(F.col("kept_bands").alias("band"), M.target_signature(F.col("kept_k"), F.col("mean")).alias("target"))
    return m.select("scene_id", "xtrack", F.explode(s).alias("s")).select("scene_id", "xtrack", "s.band", rnd("s.target", 9).alias("target"))


@query("a1_two_band_filter", "v_pixels", _TWO_SQL + """
SELECT g.scene_id, g.xtrack, line, round(CASE WHEN NOT bad THEN ((x1 - m1) * z1 + (x2 - m2) * z2) / (s1 * z1 + s2 * z2) * 100000 END, 3) AS enh FROM g JOIN z USING (scene_id, xtrack)""")
def a1two(spark, sf):
    return M.matched_filter(X.v_pixels(spark, sf), X.v_bands(spark, sf), TWO).select("scene_id", "xtrack", "line", rnd("enh", 3).alias("enh"))


@query("a1_matched_filter")
def a1(spark, sf):
    return M.matched_filter(X.v_pixels(spark, sf), X.v_bands(spark, sf)).select("scene_id", "xtrack", "line", rnd("enh", 3).alias("enh"))


@query("a3_loo_shrinkage")
def a3(spark, sf):
    _, _, good = _good(spark, sf, C.CH4_WINDOWS_NM)
    moments = materialise(M.column_moments(good), "moments")
    return M.loo_alpha(good, moments).select("scene_id", "xtrack", "alpha")


# Closed form of the leave-one-out likelihood for two bands: the matrix of each candidate is inverted by hand.
_CURVE_SQL = _TWO_SQL + """,
cv AS (SELECT scene_id, xtrack, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, 1e4 * var_samp(x1) AS a, 1e4 * covar_samp(x1, x2) AS b, 1e4 * var_samp(x2) AS d
 FROM g WHERE NOT bad GROUP BY ALL),
al AS (SELECT i, pow(10.0::DOUBLE, -10 + 0.05::DOUBLE * i) AS alpha FROM range(100, 201, 10) t(i)),
gm AS (SELECT cv.*, i, alpha, (1 - alpha) / (n - 1) AS beta, n * ((1 - alpha) / (n - 1)) * a + alpha * a AS ga,
 n * ((1 - alpha) / (n - 1)) * b AS gb, n * ((1 - alpha) / (n - 1)) * d + alpha * d AS gd FROM cv, al),
rk AS (SELECT gm.*, mode, 1e4 * (gd * y1 * y1 - 2 * gb * y1 * y2 + ga * y2 * y2) / (ga * gd - gb * gb) AS r FROM gm JOIN (
 SELECT g.scene_id, g.xtrack, unnest([{'mode': 'centred', 'y1': x1 - m1, 'y2': x2 - m2}, {'mode': 'raw', 'y1': x1, 'y2': x2}], recursive := true)
 FROM g JOIN cv USING (scene_id, xtrack) WHERE NOT bad) px USING (scene_id, xtrack))
SELECT mode, scene_id, xtrack, i, round(CASE WHEN min(1 - beta * r) > 0 THEN 0.5 * (2 * ln(2 * pi()) + ln(any_value(ga * gd - gb * gb)))
 + sum(CASE WHEN 1 - beta * r > 0 THEN ln(1 - beta * r) + r / (1 - beta * r) END) / (2 * any_value(n)) END, 6) AS nll
FROM rk GROUP BY mode, scene_id, xtrack, i"""


@query("a3_two_band_curve", "v_pixels", _CURVE_SQL)
def a3curve(spark, sf):
    """Likelihood of every tenth candidate of the upper half of the grid, raw and centred, with two bands."""
    _, _, good = _good(spark, sf, TWO)
    systems = M.eigen_systems(M.column_moments(good))
    raw = M.loo_curve(good, systems).withColumn("mode", F.lit("raw"))
    both = raw.unionByName(M.loo_curve(good, systems, centred=True).withColumn("mode", F.lit("centred")))
    i = F.round((F.log10("alpha") + 10) / 0.05).cast("bigint")
    return both.select("mode", "scene_id", "xtrack", i.alias("i"), rnd("nll", 6).alias("nll")).where("i >= 100 and i % 10 = 0")


@query("a4_shrinkage_summary")
def a4(spark, sf):
    a = materialise(a3(spark, sf), "alpha")
    p = exact_percentiles(a, ["scene_id"], F.col("alpha"), {"median": 0.5, "p95": 0.95})
    return a.groupBy("scene_id").agg(F.min("alpha").alias("min"), F.max("alpha").alias("max"), F.count("alpha").alias("n_columns")).join(
        p.drop("n_values"), "scene_id")


@query("a17_column_probe", "v_pixels", _TWO_SQL + """,
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS hi FROM z)
SELECT scene_id, xtrack, n AS n_good, round(hi / (det / hi), 4) AS cond, round(det / hi, 9) AS min_eig, round(hi, 9) AS max_eig, round(sqrt(s1 * s1 + s2 * s2), 9) AS target_norm, round(s1 * z1 + s2 * z2, 9) AS denom FROM e""")
def a17(spark, sf):
    sel, _, good = _good(spark, sf, TWO)
    m = M.column_models(M.column_moments(good), sel)
    return m.select("scene_id", "xtrack", "n_good", rnd("cond", 4).alias("cond"), *[rnd(c, 9).alias(c) for c in ("min_eig", "max_eig", "target_norm", "denom")])


@query("a17_blob_columns", "v_raster", """
t AS (SELECT scene_id, quantile_cont(abs(own), 0.99) AS cut, quantile_cont(abs(own), 0.999) AS top_cut FROM v_raster GROUP BY 1),
k AS (SELECT scene_id, c, count(*) AS n, count(*) FILTER (abs(own) > top_cut) AS n_top FROM v_raster JOIN t USING (scene_id) WHERE abs(own) > cut GROUP BY ALL)
SELECT scene_id, c, n, n_top, row_number() OVER (PARTITION BY scene_id ORDER BY n_top DESC, n DESC, c) AS rank FROM k""")
def a17b(spark, sf):
    """Every column with pixels above the 99th percentile; those above the 99.9th rank first."""
    x = X.v_raster(spark, sf).select("scene_id", "c", F.abs("own").alias("v"))
    cuts = exact_percentiles(x, ["scene_id"], F.col("v"), {"cut": 0.99, "top_cut": 0.999}).select("scene_id", "cut", "top_cut")
    n = x.join(cuts, "scene_id").where(F.col("v") > F.col("cut")).groupBy("scene_id", "c").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("v") > F.col("top_cut"), 1)).alias("n_top"))
    rank = F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("n_top"), F.desc("n"), "c"))
    return n.withColumn("rank", rank.cast("bigint"))


VARIANTS = {"wide": (((2000.0, 2300.0), (2400.0, 2800.0)), None), "narrow": (C.CH4_WINDOWS_NM, None), "notched": (C.CH4_WINDOWS_NM, (2280.0, 2320.0))}


@query("a48_filter_variants")
def a48(spark, sf):
    """Distribution of each filter variant and its correlation with the narrow one."""
    bands, pixels = X.v_bands(spark, sf), X.v_pixels(spark, sf)
    sel = None
    for name, (win, out) in VARIANTS.items():
        one = M.select_bands(bands, win, out).withColumn("variant", F.lit(name))
        sel = one if sel is None else sel.unionByName(one)
    proj = M.project_bands(pixels, sel)
    models = M.column_models(M.column_moments(M.good_pixels(proj)), sel)
    enh = materialise(M.apply_filter(proj, models), "variant-enhancement")
    ref = enh.where("variant = 'narrow'").select("scene_id", "line", F.col("enh").alias("ref"))
    p = exact_percentiles(enh, ["variant", "scene_id"], F.col("enh"), {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    r = enh.join(ref, ["scene_id", "line"]).groupBy("variant", "scene_id").agg(
        F.when(F.count(F.when(F.col("enh").isNotNull() & F.col("ref").isNotNull(), 1)) >= 100, F.corr("enh", "ref")).alias("r"))
    return p.join(r, ["variant", "scene_id"]).select("variant", "scene_id", "n_values", *[rnd(c, 3).alias(c) for c in ("p1", "p50", "p99")], rnd("r").alias("pearson"))


@query("a49_centred_shrinkage")
def a49(spark, sf):
    """Shrinkage over a spread of columns, with and without centring."""
    _, _, good = _good(spark, sf, C.CH4_WINDOWS_NM)
    span = good.groupBy("scene_id").agg(F.max("xtrack").alias("_m")).select(
        "scene_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.floor(i * F.col("_m") / 49.0)))).alias("xtrack"))
    some = good.join(span, ["scene_id", "xtrack"], "left_semi")
    mom = materialise(M.column_moments(some), "moments")
    systems = M.eigen_systems(mom)
    a = M.loo_alpha(some, mom, systems=systems).withColumn("mode", F.lit("raw"))
    b = M.loo_alpha(some, mom, centred=True, systems=systems).withColumn("mode", F.lit("centred"))
    both = materialise(a.unionByName(b), "alpha")
    p = exact_percentiles(both, ["mode", "scene_id"], F.col("alpha"), {"median": 0.5, "p95": 0.95})
    return both.groupBy("mode", "scene_id").agg(F.min("alpha").alias("min"), F.max("alpha").alias("max")).join(p, ["mode", "scene_id"])


_RESP = """
pts AS (SELECT h.scene_id, b.band, b.wl, nm, kx, exp(-0.5::DOUBLE * ((nm - wl) / (fwhm / 2.3548200450309493::DOUBLE)) ** 2) AS w FROM v_hbands b JOIN v_hires h ON h.scene_id = b.scene_id
 AND nm BETWEEN wl - 4 * (fwhm / 2.3548200450309493::DOUBLE) AND wl + 4 * (fwhm / 2.3548200450309493::DOUBLE)
 JOIN (SELECT scene_id, min(nm) AS lo, max(nm) AS hi FROM v_hires GROUP BY 1) c ON c.scene_id = b.scene_id AND wl BETWEEN lo AND hi),
"""


@query("w18_band_response", "v_hires v_hbands", _RESP + """
seg AS (SELECT scene_id, band, (w * kx + lead(w * kx) OVER q) / 2 * (lead(nm) OVER q - nm) AS num, (w + lead(w) OVER q) / 2 * (lead(nm) OVER q - nm) AS den FROM pts WINDOW q AS (PARTITION BY scene_id, band ORDER BY nm)),
r AS (SELECT scene_id, band, sum(num) / sum(den) AS k FROM seg GROUP BY ALL)
SELECT b.scene_id, b.band, b.wl, round(coalesce(k, 0) * 1e22, 6) AS k FROM v_hbands b LEFT JOIN r USING (scene_id, band)""")
def w18(spark, sf):
    return M.band_response(X.v_hires(spark, sf), X.v_hbands(spark, sf)).withColumn("k", rnd(F.col("k") * 1e22))


_STATE = "SELECT scene_id, 2.2::DOUBLE AS amf, 1e-6::DOUBLE * (101325.0::DOUBLE / (1.380649e-23::DOUBLE * 300)) * 1e-4::DOUBLE AS n_excess, 1.85::DOUBLE * 1e-6 * (101325.0::DOUBLE / (9.80665::DOUBLE * (0.0289644::DOUBLE / 6.02214076e23::DOUBLE)) * 1e-4::DOUBLE) AS n_bg FROM (SELECT DISTINCT scene_id FROM v_hbands)"


def _state(spark, sf):
    p, t = F.lit(101325.0), F.lit(300.0)
    return X.v_hbands(spark, sf).select("scene_id").distinct().select(
        "scene_id", F.lit(2.2).alias("amf"), P.excess_column_per_ppm_m(p, t).alias("n_excess"), (1.85 * 1e-6 * P.dry_air_column(p)).alias("n_background"))


@query("w19_saturating_response", "v_hires v_hbands", _RESP + f"""
st AS ({_STATE}), lad AS (SELECT pts.*, amf, n_excess, n_bg, i * 500.0::DOUBLE AS c FROM pts JOIN st USING (scene_id), (SELECT unnest(range(21)) AS i)),
ra AS (SELECT scene_id, band, c, sum(w * exp(-amf * (kx * n_bg + kx * n_excess * c))) / sum(w) AS rad FROM lad GROUP BY ALL),
sl AS (SELECT scene_id, band, regr_slope(ln(rad), c) AS k FROM ra GROUP BY ALL)
SELECT b.scene_id, b.band, b.wl, round(coalesce(k, 0) * 1e6, 6) AS k FROM v_hbands b LEFT JOIN sl USING (scene_id, band)""")
def w19(spark, sf):
    return M.saturating_response(X.v_hires(spark, sf), X.v_hbands(spark, sf), _state(spark, sf)).withColumn("k", rnd(F.col("k") * 1e6))


@query("w20_thin_absorption", "v_hires v_hbands", f"""st AS ({_STATE})
SELECT scene_id, nm, round(-(1 / cos(radians(30.0::DOUBLE)) + 1 / cos(radians(10.0::DOUBLE))) * kx * n_excess * 1e6, 9) AS k FROM v_hires JOIN st USING (scene_id)""")
def w20(spark, sf):
    h = X.v_hires(spark, sf).join(_state(spark, sf), "scene_id")
    amf = P.air_mass_factor(F.lit(30.0), F.lit(10.0))
    return h.select("scene_id", "nm", rnd(M.thin_absorption(F.col("kx"), amf, F.col("n_excess")) * 1e6, 9).alias("k"))


@query("a47_shape_agreement", "v_hires v_hbands", _RESP + """
a AS (SELECT scene_id, band, sum(w * kx) / sum(w) AS x, sum(w * kx * nm) / sum(w) - 2100 * sum(w * kx) / sum(w) AS y FROM pts GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY x) + (count(*) OVER (PARTITION BY scene_id, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY scene_id ORDER BY y) + (count(*) OVER (PARTITION BY scene_id, y) - 1) / 2.0::DOUBLE AS ry FROM a)
SELECT scene_id, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(max(abs(x / mx - y / my)), 6) AS max_shape_gap FROM rk JOIN (SELECT scene_id, max(abs(x)) AS mx, max(abs(y)) AS my FROM a GROUP BY 1) USING (scene_id) GROUP BY 1""")
def a47(spark, sf):
    p = M._points_in_band(X.v_hires(spark, sf), X.v_hbands(spark, sf), 5.0)
    wk = F.col("w") * F.col("kx")
    a = p.groupBy("scene_id", "band").agg((F.sum(wk) / F.sum("w")).alias("x"), (F.sum(wk * F.col("nm")) / F.sum("w") - 2100 * F.sum(wk) / F.sum("w")).alias("y"))
    # One row per band of the sensor: windows by scene are small.
    avg_rank = lambda c: F.rank().over(W.partitionBy("scene_id").orderBy(c)) + (F.count("*").over(W.partitionBy("scene_id", c)) - 1) / 2.0
    top = lambda c: F.max(F.abs(F.col(c))).over(W.partitionBy("scene_id"))
    r = a.select("scene_id", "x", "y", avg_rank("x").alias("rx"), avg_rank("y").alias("ry"), (F.col("x") / top("x")).alias("nx"), (F.col("y") / top("y")).alias("ny"))
    return r.groupBy("scene_id").agg(rnd(F.corr("x", "y")).alias("pearson"), rnd(F.corr("rx", "ry")).alias("spearman"), rnd(F.max(F.abs(F.col("nx") - F.col("ny")))).alias("max_shape_gap"))


@query("a46_scene_geometry", "", """
SELECT vec_id // 500 AS scene_id, round(avg(embedding[1]) FILTER (vec_id % 11 <> 0), 6) AS mean_zenith, round(avg(embedding[2]) FILTER (vec_id % 7 <> 0), 6) AS mean_elev FROM
(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings) GROUP BY 1""")
def a46(spark, sf):
    e = X.table(spark, sf, "embeddings", ["vec_id", "embedding"])
    z = F.when(F.expr("vec_id % 11 = 0"), -9999.0).otherwise(F.get("embedding", F.lit(0)).cast("double"))
    h = F.when(F.expr("vec_id % 7 = 0"), -9999.0).otherwise(F.get("embedding", F.lit(1)).cast("double"))
    return e.groupBy(F.expr("vec_id div 500").alias("scene_id")).agg(
        rnd(F.avg(F.when(z > -900, z))).alias("mean_zenith"), rnd(F.avg(F.when(h > -1000, h))).alias("mean_elev"))
