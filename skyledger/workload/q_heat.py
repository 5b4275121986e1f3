"""Heat lane: season axis, climatology, criteria, daily aggregates, runs, stations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo
from ..operators import climate, components, raster, runs
from ..sources import stations
from ..session import materialise, scratch_path
from . import fixtures as X
from .registry import big, query, rnd, rnd_scaled

VARIANTS = [("central", 1995, 2000, 10), ("early", 1995, 1997, 10), ("late", 1998, 2000, 10), ("wide", 1995, 2000, 15)]
CENTRAL = VARIANTS[:1]
CELL = climate.CELL


def _clim(spark, sf, variants=CENTRAL):
    return climate.window_climatology(X.v_days(spark, sf), X.EVENT_YEAR, variants)


def _cells(spark, sf, variants=CENTRAL):
    return climate.lane_cells(_clim(spark, sf, variants), X.v_land(spark, sf))


def _days(spark, sf, variants=CENTRAL):
    return climate.lane_days(_cells(spark, sf, variants), X.v_land(spark, sf), X.grid_tasks(spark, sf))


@query("p9_season_axis", "v_grid", """
yrs AS (SELECT DISTINCT year(day) AS y FROM v_grid),
ax AS (SELECT y AS year, d::DATE AS day FROM yrs, unnest(generate_series(make_date(y, 3, 13), make_date(y, 5, 1), INTERVAL 1 DAY)) t(d)),
nn AS (SELECT day, count(*) AS n FROM v_grid GROUP BY 1)
SELECT year, ax.day, row_number() OVER (PARTITION BY year ORDER BY ax.day) - 1 AS day_idx, coalesce(n, 0) AS n_cells FROM ax LEFT JOIN nn USING (day)""")
def p9(spark, sf):
    g = X.v_grid(spark, sf)
    axis = climate.season_axis(g.select(F.year("day").cast("bigint").alias("year")).distinct(), (3, 13), (5, 1))
    n = g.groupBy("day").agg(F.count("*").alias("n"))
    return axis.join(n, "day", "left").select("year", "day", "day_idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_cells"))


@query("p10_land_mask", "v_days v_land", """
SELECT region_id, year, count(*) AS n_days, sum(tmax) AS total FROM v_days JOIN v_land USING (region_id, lat_i, lon_i) WHERE lsm > 0.5 GROUP BY ALL""")
def p10(spark, sf):
    land = X.v_land(spark, sf).where(F.col("lsm") > 0.5).select(*CELL)
    return X.v_days(spark, sf).join(land, CELL).groupBy("region_id", "year").agg(
        F.count("*").alias("n_days"), F.sum("tmax").alias("total"))


@query("p11_qualifying_cells", "v_lane", """
SELECT region_id, day_idx, count(*) AS n_cells, count(*) FILTER (hot) AS n_qualify FROM v_lane WHERE variant = 'central' GROUP BY ALL""")
def p11(spark, sf):
    return _cells(spark, sf).groupBy("region_id", "day_idx").agg(
        F.count("*").alias("n_cells"), F.count(F.when(F.col("qualify"), 1)).alias("n_qualify"))


@query("w1_climatology", "v_clim", """
SELECT variant, region_id, lat_i, lon_i, day_idx, tmax, round(clim, 6) AS clim, clim_n FROM v_clim""")
def w1(spark, sf):
    return _clim(spark, sf, VARIANTS).withColumn("clim", rnd("clim"))


def _pool(spark, sf):
    return climate.window_percentile(X.v_days(spark, sf), 1995, 2000, C.HALF_WINDOW, 0.95)


@query("w2_window_p95", "v_pool", """SELECT region_id, lat_i, lon_i, day_idx, round(pctl, 6) AS pctl, n_pool FROM v_pool""")
def w2(spark, sf):
    return _pool(spark, sf).select(*CELL, "day_idx", rnd("pctl").alias("pctl"), "n_pool")


@query("p12_exceeds_p95", "v_pool v_days", """
SELECT region_id, year, count(*) AS n, count(*) FILTER (tmax > pctl) AS n_exceed FROM v_days JOIN v_pool USING (region_id, lat_i, lon_i, day_idx) GROUP BY ALL""")
def p12(spark, sf):
    return X.v_days(spark, sf).join(_pool(spark, sf), [*CELL, "day_idx"]).groupBy("region_id", "year").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("tmax") > F.col("pctl"), 1)).alias("n_exceed"))


@query("w3_computable_days", "v_clim", """
SELECT variant, region_id, min(day_idx) AS first_day, max(day_idx) AS last_day, count(DISTINCT day_idx) AS n_days FROM v_clim GROUP BY ALL""")
def w3(spark, sf):
    return _clim(spark, sf, VARIANTS).groupBy("variant", "region_id").agg(
        F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"), F.countDistinct("day_idx").alias("n_days"))


@query("w4_lane_days", "v_laned", """
SELECT region_id, variant, day_idx, round(extent_km2, 3) AS extent_km2, round(mean_anomaly, 6) AS mean_anomaly, round(peak_anomaly, 6) AS peak_anomaly,
peak_tmax, round(area_frac, 6) AS area_frac FROM v_laned""")
def w4(spark, sf):
    return _days(spark, sf, VARIANTS).select(
        "region_id", "variant", "day_idx", rnd("extent_km2", 3).alias("extent_km2"), rnd("mean_anomaly").alias("mean_anomaly"),
        rnd("peak_anomaly").alias("peak_anomaly"), "peak_tmax", rnd("area_frac").alias("area_frac"))


@query("a21_regional_mean", "v_lane", """
SELECT region_id, day_idx, round(sum(anomaly * area) / sum(area), 6) AS mean_anomaly FROM v_lane WHERE variant = 'central' AND anomaly IS NOT NULL GROUP BY ALL""")
def a21(spark, sf):
    return _cells(spark, sf).groupBy("region_id", "day_idx").agg(
        rnd(climate.weighted_mean(F.col("anomaly"), F.col("area"))).alias("mean_anomaly"))


@query("a22_area_fraction", "v_laned", """
SELECT region_id, arg_max(day_idx, {'a': round(area_frac, 9), 'b': -day_idx}) AS peak_day, round_even(max(extent_km2), -2) AS extent_km2, round(max(area_frac), 4) AS area_frac
FROM v_laned WHERE variant = 'central' GROUP BY ALL""")
def a22(spark, sf):
    return _days(spark, sf).groupBy("region_id").agg(
        F.max_by("day_idx", F.struct(F.round("area_frac", 9).alias("a"), -F.col("day_idx"))).alias("peak_day"),
        F.bround(F.max("extent_km2"), -2).alias("extent_km2"), rnd(F.max("area_frac"), 4).alias("area_frac"))


@query("a23_peak_cell", "v_lane", """
SELECT region_id, value, p.d AS day_idx, p.a AS lat_i, p.b AS lon_i FROM (SELECT region_id, max(tmax) AS value,
arg_min({'d': day_idx, 'a': lat_i, 'b': lon_i}, {'v': -tmax, 'd': day_idx, 'a': lat_i, 'b': lon_i}) AS p FROM v_lane WHERE variant = 'central' GROUP BY 1)""")
def a23(spark, sf):
    order = F.struct((-F.col("tmax")).alias("v"), "day_idx", "lat_i", "lon_i")
    return _cells(spark, sf).groupBy("region_id").agg(
        F.max("tmax").alias("value"), F.min_by(F.struct("day_idx", "lat_i", "lon_i"), order).alias("p")
    ).select("region_id", "value", "p.*")


@query("a24_anomaly_summary", "v_laned", """
SELECT region_id, round(max(mean_anomaly), 2) AS peak_regional, arg_min(day_idx, {'a': -mean_anomaly, 'b': day_idx}) AS peak_day,
round(avg(mean_anomaly), 3) AS window_mean, round(max(peak_anomaly), 2) AS peak_cell FROM v_laned WHERE variant = 'central' GROUP BY 1""")
def a24(spark, sf):
    return _days(spark, sf).groupBy("region_id").agg(
        rnd(F.max("mean_anomaly"), 2).alias("peak_regional"),
        F.min_by("day_idx", F.struct((-F.col("mean_anomaly")).alias("a"), "day_idx")).alias("peak_day"),
        rnd(F.avg("mean_anomaly"), 3).alias("window_mean"), rnd(F.max("peak_anomaly"), 2).alias("peak_cell"))


@query("a26_extent_p95", "v_pool v_days v_land", """
SELECT region_id, day_idx, round(sum(CASE WHEN tmax > pctl THEN (6371.0088::DOUBLE * pi() / 180) ** 2 * cos(radians(v_days.lat)) ELSE 0 END), 3) AS extent_km2
FROM v_days JOIN v_pool USING (region_id, lat_i, lon_i, day_idx) JOIN v_land USING (region_id, lat_i, lon_i) WHERE year = 2001 AND lsm > 0.5 GROUP BY ALL""")
def a26(spark, sf):
    land = X.v_land(spark, sf).where(F.col("lsm") > 0.5).select(*CELL)
    d = X.v_days(spark, sf).where(F.col("year") == X.EVENT_YEAR).join(_pool(spark, sf), [*CELL, "day_idx"]).join(land, CELL)
    area = climate.cell_area_km2(F.col("lat"))
    return d.groupBy("region_id", "day_idx").agg(
        rnd(F.sum(F.when(F.col("tmax") > F.col("pctl"), area).otherwise(0.0)), 3).alias("extent_km2"))


@query("a27_coarsen", "v_days", """
SELECT region_id, year, day_idx, floor((lat - 22.5 + 1) / 2)::BIGINT AS ci, floor((lon - 70.5 + 1) / 2)::BIGINT AS cj, round(avg(tmax), 6) AS value FROM v_days
WHERE floor((lat - 22.5 + 1) / 2) BETWEEN 0 AND 1 AND floor((lon - 70.5 + 1) / 2) BETWEEN 0 AND 1 GROUP BY ALL""")
def a27(spark, sf):
    out = raster.coarsen(X.v_days(spark, sf), ["region_id", "year", "day_idx"], F.col("lat"), F.col("lon"), F.col("tmax"),
                         (22.5, 70.5), (2.0, 2.0), (2, 2))
    return out.withColumn("value", rnd("value"))


@query("j7_coarse_cell", "v_grid", """
SELECT region_id, floor((lat - 23.0 + 1) / 2)::BIGINT AS ci, floor((lon - 71.0 + 1) / 2)::BIGINT AS cj, count(*) AS n FROM v_grid GROUP BY ALL""")
def j7(spark, sf):
    return X.v_grid(spark, sf).groupBy(
        "region_id", raster.coarse_index(F.col("lat"), 23.0, 2.0).alias("ci"), raster.coarse_index(F.col("lon"), 71.0, 2.0).alias("cj")
    ).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ second product


def _second_cells(spark, sf):
    clim = climate.window_climatology(X.v_second(spark, sf), X.EVENT_YEAR, CENTRAL)
    return climate.lane_cells(clim, X.v_land(spark, sf))


_SECOND = """
sclim AS (SELECT e.region_id, e.lat_i, e.lon_i, e.day_idx, e.tmax, sum(b.tmax) / count(b.tmax) AS clim FROM v_second e LEFT JOIN v_second b
 ON b.region_id = e.region_id AND b.lat_i = e.lat_i AND b.lon_i = e.lon_i AND b.year BETWEEN 1995 AND 2000 AND b.day_idx BETWEEN e.day_idx - 10 AND e.day_idx + 10
 WHERE e.year = 2001 AND e.day_idx BETWEEN 10 AND 354 GROUP BY ALL),
slane AS (SELECT s.*, lat, (6371.0088::DOUBLE * pi() / 180) ** 2 * cos(radians(lat)) AS area, tmax - clim AS anomaly,
 coalesce(tmax + 273.15::DOUBLE >= 313.15::DOUBLE AND (tmax + 273.15::DOUBLE) - (clim + 273.15::DOUBLE) >= 4.5::DOUBLE, false) AS hot FROM sclim s JOIN v_land USING (region_id, lat_i, lon_i) WHERE lsm > 0.5)
"""


@query("a28_product_agreement", "v_lane v_second v_land", _SECOND + """,
a AS (SELECT region_id, lat_i, lon_i, any_value(area) AS area, avg(anomaly) AS x FROM v_lane WHERE variant = 'central' GROUP BY 1, 2, 3),
b AS (SELECT region_id, lat_i, lon_i, avg(anomaly) AS y FROM slane GROUP BY 1, 2, 3),
j AS (SELECT * FROM a JOIN b USING (region_id, lat_i, lon_i) WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT region_id, count(*) AS n_cells, round(sum(x * area) / sum(area), 6) AS own_mean, round(sum(y * area) / sum(area), 6) AS other_mean,
round(corr(x, y), 6) AS pattern_r, abs(sum(x * area) / sum(area) - sum(y * area) / sum(area)) <= 1.0 AS pass_mean, corr(x, y) >= 0.6 AS pass_pattern FROM j GROUP BY 1""")
def a28(spark, sf):
    a = _cells(spark, sf).groupBy(*CELL, "area").agg(F.avg("anomaly").alias("x"))
    b = _second_cells(spark, sf).groupBy(*CELL).agg(F.avg("anomaly").alias("y"))
    j = a.join(b, CELL).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    wm = lambda v: F.sum(F.col(v) * F.col("area")) / F.sum("area")
    g = j.groupBy("region_id").agg(F.count("*").alias("n_cells"), wm("x").alias("a"), wm("y").alias("b"), F.corr("x", "y").alias("r"))
    return g.select("region_id", "n_cells", rnd("a").alias("own_mean"), rnd("b").alias("other_mean"), rnd("r").alias("pattern_r"),
                    (F.abs(F.col("a") - F.col("b")) <= 1.0).alias("pass_mean"), (F.col("r") >= 0.6).alias("pass_pattern"))


@query("u2_common_cells", "v_days v_second", """
SELECT region_id, count(*) AS n_common FROM (SELECT DISTINCT region_id, lat_i, lon_i, year, day_idx FROM v_days INTERSECT SELECT DISTINCT region_id, lat_i, lon_i, year, day_idx FROM v_second) GROUP BY 1""")
def u2(spark, sf):
    keys = [*CELL, "year", "day_idx"]
    return X.v_days(spark, sf).select(*keys).join(X.v_second(spark, sf).select(*keys), keys).groupBy("region_id").agg(
        F.count("*").alias("n_common"))


_RUNSQL = """
hit AS (SELECT *, day_idx - row_number() OVER (PARTITION BY region_id ORDER BY day_idx) AS isle FROM dd WHERE area_frac >= 0.05),
isles AS (SELECT region_id, min(day_idx) AS run_start, max(day_idx) AS run_end FROM hit GROUP BY region_id, isle),
span AS (SELECT region_id, min(day_idx) AS f, max(day_idx) AS l FROM dd GROUP BY 1)
"""


@query("w5_anchored_run", "v_laned v_land", """
dd AS (SELECT * FROM v_laned WHERE variant = 'central'),""" + _RUNSQL + """,
anchors AS (SELECT region_id, unnest([12, 98, 180, 250, 300, 360])::BIGINT AS anchor FROM (SELECT DISTINCT region_id FROM v_land))
SELECT a.region_id, anchor, CASE WHEN d.area_frac IS NULL THEN 'anchor not computed' WHEN d.area_frac < 0.05 THEN 'anchor below threshold' ELSE 'ok' END AS status,
run_start, run_end, run_end - run_start + 1 AS n_days, run_start = f OR run_end = l AS touches_edge
FROM anchors a LEFT JOIN dd d ON d.region_id = a.region_id AND d.day_idx = anchor LEFT JOIN span s ON s.region_id = a.region_id
LEFT JOIN isles i ON i.region_id = a.region_id AND anchor BETWEEN run_start AND run_end""")
def w5(spark, sf):
    days = materialise(_days(spark, sf).select("region_id", F.col("day_idx").alias("pos"), "area_frac"), "lane-days")
    anchors = X.v_land(spark, sf).select("region_id").distinct().select(
        "region_id", F.explode(F.array(*[F.lit(a).cast("bigint") for a in (12, 98, 180, 250, 300, 360)])).alias("anchor"))
    return runs.anchored_run(days, anchors, 0.05, ["region_id"])


@query("a29_duration_extent", "v_laned v_second v_land", _SECOND + """,
sd AS (SELECT region_id, day_idx, sum(CASE WHEN hot THEN area ELSE 0 END) AS extent_km2, sum(CASE WHEN hot THEN area ELSE 0 END) / any_value(land_area) AS area_frac FROM slane JOIN v_landtotal USING (region_id) GROUP BY ALL),
dd AS (SELECT region_id, 'own' AS lane, day_idx, extent_km2, area_frac FROM v_laned WHERE variant = 'central' UNION ALL SELECT region_id, 'other', day_idx, extent_km2, area_frac FROM sd),
hit AS (SELECT *, day_idx - row_number() OVER (PARTITION BY region_id, lane ORDER BY day_idx) AS isle FROM dd WHERE area_frac >= 0.05),
isles AS (SELECT region_id, lane, min(day_idx) AS s, max(day_idx) AS e, max(day_idx) - min(day_idx) + 1 AS n FROM hit GROUP BY region_id, lane, isle),
peak AS (SELECT region_id, arg_max(day_idx, {'a': area_frac, 'b': -day_idx}) AS peak_day FROM dd WHERE lane = 'own' GROUP BY 1),
x AS (SELECT p.region_id, p.peak_day, max(n) FILTER (i.lane = 'own') AS n_own, max(n) FILTER (i.lane = 'other') AS n_other FROM peak p LEFT JOIN isles i ON i.region_id = p.region_id AND p.peak_day BETWEEN s AND e GROUP BY ALL),
y AS (SELECT x.*, coalesce(max(extent_km2) FILTER (lane = 'own'), 0) AS e_own, coalesce(max(extent_km2) FILTER (lane = 'other'), 0) AS e_other FROM x JOIN dd ON dd.region_id = x.region_id AND dd.day_idx = x.peak_day GROUP BY ALL)
SELECT region_id, peak_day, n_own, n_other, coalesce(abs(n_own - n_other) <= 2, false) AS pass_duration, round_even(e_own, -2) AS extent_own, round_even(e_other, -2) AS extent_other,
CASE WHEN e_other > 0 THEN round(abs(e_own - e_other) / e_other, 3) END AS rel, e_other > 0 AND abs(e_own - e_other) / greatest(e_other, 1e-9) <= 0.30 AS pass_extent FROM y""")
def a29(spark, sf):
    land = X.v_land(spark, sf)
    own = _days(spark, sf).withColumn("lane", F.lit("own"))
    other = climate.lane_days(_second_cells(spark, sf), land, X.grid_tasks(spark, sf)).withColumn("lane", F.lit("other"))
    cols = ["region_id", "lane", F.col("day_idx").alias("pos"), "extent_km2", "area_frac"]
    both = materialise(own.select(*cols).unionByName(other.select(*cols)), "lane-days")
    # Days with the same hot cells are ties; unrounded, the order in which their areas were summed would choose among them.
    first_peak = F.struct(F.round("area_frac", 9).alias("a"), -F.col("pos"))
    peak = both.where("lane = 'own'").groupBy("region_id").agg(F.max_by("pos", first_peak).alias("anchor"))
    anchors = peak.select("region_id", "anchor", F.explode(F.array(F.lit("own"), F.lit("other"))).alias("lane"))
    run = runs.anchored_run(both, anchors, 0.05, ["region_id", "lane"])
    pick = lambda lane, v: F.max(F.when(F.col("lane") == lane, F.col(v)))
    dur = run.groupBy("region_id", "anchor").agg(pick("own", "n_days").alias("n_own"), pick("other", "n_days").alias("n_other"))
    ext = both.join(peak, "region_id").where(F.col("pos") == F.col("anchor")).groupBy("region_id").agg(
        F.coalesce(pick("own", "extent_km2"), F.lit(0.0)).alias("e_own"), F.coalesce(pick("other", "extent_km2"), F.lit(0.0)).alias("e_other"))
    rel = F.when(F.col("e_other") > 0, F.abs(F.col("e_own") - F.col("e_other")) / F.col("e_other"))
    return dur.join(ext, "region_id").select(
        "region_id", F.col("anchor").alias("peak_day"), "n_own", "n_other",
        F.coalesce(F.abs(F.col("n_own") - F.col("n_other")) <= 2, F.lit(False)).alias("pass_duration"),
        F.bround("e_own", -2).alias("extent_own"), F.bround("e_other", -2).alias("extent_other"),
        rnd(rel, 3).alias("rel"), F.coalesce(rel <= 0.30, F.lit(False)).alias("pass_extent"))


@query("a32_uncertainty_budget", "v_laned", """
v AS (SELECT region_id, variant, avg(mean_anomaly) AS m, max(extent_km2) AS e FROM v_laned GROUP BY ALL),
p AS (SELECT region_id, max(m) FILTER (variant = 'central') AS c, max(m) FILTER (variant = 'early') AS a, max(m) FILTER (variant = 'late') AS b, max(m) FILTER (variant = 'wide') AS w,
 max(e) FILTER (variant = 'central') AS ec, max(e) FILTER (variant = 'early') AS ea, max(e) FILTER (variant = 'late') AS eb FROM v GROUP BY 1)
SELECT region_id, round(c, 6) AS central, round(abs(a - b) / 2, 6) AS half_spread, round(abs(w - c), 6) AS window_shift, round(ec, 3) AS extent_central, round(ea, 3) AS extent_early, round(eb, 3) AS extent_late FROM p""")
def a32(spark, sf):
    v = _days(spark, sf, VARIANTS).groupBy("region_id", "variant").agg(F.avg("mean_anomaly").alias("m"), F.max("extent_km2").alias("e"))
    g = lambda n, c: F.max(F.when(F.col("variant") == n, F.col(c)))
    p = v.groupBy("region_id").agg(g("central", "m").alias("c"), g("early", "m").alias("a"), g("late", "m").alias("b"), g("wide", "m").alias("w"),
                                   g("central", "e").alias("ec"), g("early", "e").alias("ea"), g("late", "e").alias("eb"))
    return p.select("region_id", rnd("c").alias("central"), rnd(F.abs(F.col("a") - F.col("b")) / 2).alias("half_spread"),
                    rnd(F.abs(F.col("w") - F.col("c"))).alias("window_shift"), rnd("ec", 3).alias("extent_central"),
                    rnd("ea", 3).alias("extent_early"), rnd("eb", 3).alias("extent_late"))


@query("g8_union_footprint", "v_lane", """
c AS (SELECT region_id, lat_i, lon_i, lat, lon, bool_or(hot) AS q, avg(anomaly) AS a FROM v_lane WHERE variant = 'central' GROUP BY ALL)
SELECT region_id, count(*) AS n_cells, min(lon) - 0.5::DOUBLE AS min_lon, max(lon) + 0.5::DOUBLE AS max_lon, min(lat) - 0.5::DOUBLE AS min_lat, max(lat) + 0.5::DOUBLE AS max_lat,
round(sum(lat * a) / sum(a), 6) AS centre_lat, round(sum(lon * a) / sum(a), 6) AS centre_lon FROM c WHERE q GROUP BY 1""")
def g8(spark, sf):
    c = _cells(spark, sf).groupBy(*CELL, "lat", "lon").agg(F.bool_or("qualify").alias("q"), F.avg("anomaly").alias("a")).where("q")
    return c.groupBy("region_id").agg(
        F.count("*").alias("n_cells"), (F.min("lon") - 0.5).alias("min_lon"), (F.max("lon") + 0.5).alias("max_lon"),
        (F.min("lat") - 0.5).alias("min_lat"), (F.max("lat") + 0.5).alias("max_lat"),
        rnd(F.sum(F.col("lat") * F.col("a")) / F.sum("a")).alias("centre_lat"), rnd(F.sum(F.col("lon") * F.col("a")) / F.sum("a")).alias("centre_lon"))


# ------------------------------------------------------------------ scan of all years

_RECORDS = """
fam AS (SELECT d.*, mean_pool, land.lsm, unnest([{'f': 'p95', 'q': d.tmax > pctl, 'r': pctl}, {'f': 'absolute', 'q': d.tmax >= 40 AND d.tmax - mean_pool >= 4.5, 'r': mean_pool}]) AS x
 FROM v_days d JOIN v_pool USING (region_id, lat_i, lon_i, day_idx) JOIN v_land land USING (region_id, lat_i, lon_i) WHERE lsm > 0.5),
g AS (SELECT region_id, x.f AS family, year, day_idx, coalesce(sum(CASE WHEN x.q THEN cos(radians(lat)) END), 0) AS wf, sum(CASE WHEN x.q THEN (tmax - x.r) * cos(radians(lat)) END) AS sev,
 sum(CASE WHEN x.q THEN lat_i * cos(radians(lat)) END) AS ci, sum(CASE WHEN x.q THEN lon_i * cos(radians(lat)) END) AS cj, max(CASE WHEN x.q THEN tmax - mean_pool END) AS pk FROM fam GROUP BY ALL),
rec AS (SELECT region_id, family, year, day_idx, round_even(wf / w, 4) AS area_frac, CASE WHEN wf > 0 THEN round_even(sev / wf, 3) ELSE 0 END AS severity, CASE WHEN wf > 0 THEN round_even(pk, 2) ELSE 0 END AS peak_anomaly,
 CASE WHEN wf > 0 THEN round_even(ci / wf, 2) END AS centroid_i, CASE WHEN wf > 0 THEN round_even(cj / wf, 2) END AS centroid_j FROM g JOIN v_landtotal USING (region_id))
"""


def _records(spark, sf):
    land = X.v_land(spark, sf)
    d = X.v_days(spark, sf).join(_pool(spark, sf), [*CELL, "day_idx"]).join(land.where(F.col("lsm") > 0.5).select(*CELL), CELL)
    t = F.col("tmax")
    fam = F.array(
        F.struct(F.lit("p95").alias("family"), (t > F.col("pctl")).alias("q"), F.col("pctl").alias("ref")),
        F.struct(F.lit("absolute").alias("family"), ((t >= 40) & (t - F.col("mean_pool") >= 4.5)).alias("q"), F.col("mean_pool").alias("ref")))
    cells = d.withColumn("x", F.explode(fam)).select("*", "x.*")
    r = climate.exceedance_records(cells, land, F.col("ref"), F.col("mean_pool"), F.col("q"))
    b = F.bround
    return r.select("region_id", "family", "year", "day_idx", b("area_frac", 4).alias("area_frac"), b("severity", 3).alias("severity"),
                    b("peak_anomaly", 2).alias("peak_anomaly"), b("centroid_i", 2).alias("centroid_i"), b("centroid_j", 2).alias("centroid_j"))


@query("w8_daily_records", "v_days v_pool v_land v_landtotal", _RECORDS + "SELECT * FROM rec")
def w8(spark, sf):
    return _records(spark, sf)


@query("u1_criterion_families", "v_days v_pool v_land v_landtotal", _RECORDS + """
SELECT family, region_id, year, count(*) AS n_days, count(*) FILTER (area_frac >= 0.3) AS n_hit, round(avg(area_frac), 6) AS mean_frac FROM rec GROUP BY ALL""")
def u1(spark, sf):
    return _records(spark, sf).groupBy("family", "region_id", "year").agg(
        F.count("*").alias("n_days"), F.count(F.when(F.col("area_frac") >= 0.3, 1)).alias("n_hit"), rnd(F.avg("area_frac")).alias("mean_frac"))


_RUNS = _RECORDS + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY region_id, family ORDER BY year, day_idx) AS pos FROM rec),
h AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY region_id, family ORDER BY pos) > 2 THEN 1 ELSE 0 END AS fresh FROM pos WHERE area_frac >= CASE family WHEN 'p95' THEN 0.05 ELSE 0.15 END),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY region_id, family ORDER BY pos)::BIGINT AS run_id FROM h),
summ AS (SELECT region_id, family, run_id, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_days, round(sum(area_frac * severity), 3) AS score, max(area_frac) AS peak_area_frac,
 arg_min(pos, {'a': -area_frac, 'b': pos}) AS peak_pos, max(peak_anomaly) AS peak_anomaly, round(avg(centroid_i), 6) AS centroid_i, round(avg(centroid_j), 6) AS centroid_j FROM rn GROUP BY ALL HAVING count(*) >= 3)
"""


def _hits(spark, sf):
    w = W.partitionBy("region_id", "family").orderBy("year", "day_idx")
    pos = _records(spark, sf).withColumn("pos", F.row_number().over(w).cast("bigint"))
    scaled = pos.withColumn("_frac", F.col("area_frac")).withColumn(
        "area_frac", F.when(F.col("family") == "p95", F.col("area_frac") - 0.05).otherwise(F.col("area_frac") - 0.15))
    return runs.gap_runs(scaled, ["region_id", "family"], -1e-12).withColumn("area_frac", F.col("_frac")).drop("_frac")


@query("w6_gap_runs", "v_days v_pool v_land v_landtotal", _RUNS + "SELECT region_id, family, year, day_idx, pos, run_id, area_frac FROM rn")
def w6(spark, sf):
    return _hits(spark, sf).select("region_id", "family", "year", "day_idx", "pos", big("run_id").alias("run_id"), "area_frac")


def _summary(spark, sf):
    s = runs.summarise_runs(_hits(spark, sf), ["region_id", "family"])
    return s.select("region_id", "family", big("run_id").alias("run_id"), "start_pos", "end_pos", "n_days", rnd("score", 3).alias("score"), "peak_area_frac",
                    "peak_pos", "peak_anomaly", rnd("centroid_i").alias("centroid_i"), rnd("centroid_j").alias("centroid_j"))


@query("w7_run_summary", "v_days v_pool v_land v_landtotal", _RUNS + "SELECT * FROM summ")
def w7(spark, sf):
    return _summary(spark, sf)


@query("t5_top_runs", "v_days v_pool v_land v_landtotal", _RUNS + """
SELECT region_id, family, start_pos, n_days, score FROM summ ORDER BY score DESC, region_id, family, start_pos LIMIT 50""")
def t5(spark, sf):
    s = _summary(spark, sf).select("region_id", "family", "start_pos", "n_days", "score")
    return runs.top_rows(s, [F.col("score").desc(), F.col("region_id"), F.col("family"), F.col("start_pos")], 50)


@query("t5_top_days", "v_days v_pool v_land v_landtotal", _RECORDS + """
SELECT region_id, year, day_idx, area_frac, severity FROM rec WHERE family = 'absolute' ORDER BY area_frac DESC, region_id, year, day_idx LIMIT 50""")
def t5_days(spark, sf):
    d = _records(spark, sf).where("family = 'absolute'").select("region_id", "year", "day_idx", "area_frac", "severity")
    return runs.top_rows(d, [F.col("area_frac").desc(), F.col("region_id"), F.col("year"), F.col("day_idx")], 50)


# ------------------------------------------------------------------ stations


@query("p7_parse_temperature", "v_temps", "SELECT station, ts, event_id, temp_c FROM v_temps")
def p7(spark, sf):
    return stations.parse_temps(X.v_obs(spark, sf))


@query("s1_station_scan", "v_temps", "SELECT station::VARCHAR AS station, date_trunc('second', ts)::TIMESTAMP AS ts, event_id, temp_c FROM v_temps")
def s1(spark, sf):
    path = scratch_path(spark, "stations")
    obs = X.v_obs(spark, sf).select("station", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DATE"), F.col("tmp").alias("TMP"), "event_id")
    # One file a station, however many tasks read the events.
    obs.repartition("station").write.partitionBy("station").option("header", True).csv(path)
    return stations.parse_temps(stations.read_station_csv(spark, path))


@query("p8_observing_hours", "v_temps", """
SELECT station, ts::DATE AS day, count(*) AS n FROM v_temps WHERE hour(ts) BETWEEN 6 AND 13 AND ts::DATE IN (SELECT DISTINCT ts::DATE FROM v_temps WHERE day(ts) % 2 = 1) GROUP BY ALL""")
def p8(spark, sf):
    t = stations.parse_temps(X.v_obs(spark, sf)).withColumn("day", F.to_date("ts"))
    wanted = t.where(F.dayofmonth("day") % 2 == 1).select("day").distinct()
    return t.where(stations.observing_hours(F.col("ts"))).join(wanted, "day", "left_semi").groupBy("station", "day").agg(F.count("*").alias("n"))


def _station_max(spark, sf):
    return stations.daily_max(stations.parse_temps(X.v_obs(spark, sf)))


@query("a19_station_daily_max", "v_stationmax", "SELECT * FROM v_stationmax")
def a19(spark, sf):
    return _station_max(spark, sf)


@query("a19_grid_daily_max", "", """
SELECT l_suppkey // 50 AS region_id, l_partkey % 4 AS lat_i, l_suppkey % 4 AS lon_i, l_shipdate::DATE AS day, max(l_quantity) AS tmax,
arg_min(l_linenumber, {'a': -l_quantity, 'b': l_linenumber})::BIGINT AS slot_of_max FROM lineitem GROUP BY ALL""")
def a19g(spark, sf):
    li = X.table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_linenumber"])
    return li.groupBy(F.expr("l_suppkey div 50").alias("region_id"), F.expr("l_partkey % 4").alias("lat_i"), F.expr("l_suppkey % 4").alias("lon_i"),
                      F.to_date("l_shipdate").alias("day")).agg(
        F.max("l_quantity").alias("tmax"),
        F.min_by("l_linenumber", F.struct((-F.col("l_quantity")).alias("a"), "l_linenumber")).cast("bigint").alias("slot_of_max"))


@query("a20_station_screen", "v_stationmax", """
SELECT station, count(*) AS n_days, max(tmax_c) AS window_max_c, count(*) >= 7 AS kept FROM v_stationmax GROUP BY 1""")
def a20(spark, sf):
    return stations.screen_stations(_station_max(spark, sf))


def _station_grid(spark, sf):
    """Station days beside the grid value of the nearest cell (the grid on the -180..180 convention)."""
    g = X.v_weather(spark, sf).groupBy("cell_i", "cell_j", F.to_date(F.timestamp_seconds("ts")).alias("day")).agg(F.max("t2m").alias("t2m"))
    s = _station_max(spark, sf).select(
        "*", F.expr("10.0D + 0.25D * (station % 20) + 0.02D").alias("lat"), F.expr("-10.0D + 0.25D * (station div 20) - 0.03D").alias("lon"))
    lon = geo.normalise_lon(F.col("lon"), -10.0, 350.0)
    s = s.withColumn("cell_i", raster.nearest_index(F.col("lat"), 10.0, 0.25)).withColumn("cell_j", raster.nearest_index(lon, 350.0, 0.25))
    return s.join(g, ["cell_i", "cell_j", "day"]).select("station", "day", "tmax_c", (F.col("t2m") - 273.15 + 5.0).alias("grid_c"))


@query("j6_station_grid", "v_stationgrid", "SELECT station, day, tmax_c, round(grid_c, 6) AS grid_c FROM v_stationgrid")
def j6(spark, sf):
    return _station_grid(spark, sf).withColumn("grid_c", rnd_scaled("grid_c", 6))


@query("a30_station_consistency", "v_stationgrid", """
d AS (SELECT *, grid_c - tmax_c AS b FROM v_stationgrid)
SELECT count(DISTINCT station) AS n_stations, count(*) AS n_days, round(median(b), 6) AS median_bias, round(sqrt(avg(b * b)), 6) AS rmsd, round(corr(grid_c, tmax_c), 6) AS r,
abs(median(b)) <= 1.5 AND sqrt(avg(b * b)) <= 2.5 AND corr(grid_c, tmax_c) >= 0.85 AS passed FROM d""")
def a30(spark, sf):
    from ..operators.percentiles import exact_percentiles

    d = materialise(_station_grid(spark, sf).withColumn("b", F.col("grid_c") - F.col("tmax_c")), "station-pairs")
    none = lambda t: F.lit(None).cast(t)
    med = exact_percentiles(d, [], F.col("b"), {"m": 0.5}).select(
        none("bigint").alias("n_stations"), none("bigint").alias("n_days"), none("double").alias("e"), none("double").alias("c"), "m")
    s = d.agg(F.countDistinct("station").alias("n_stations"), F.count("*").alias("n_days"),
              F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("e"), F.corr("grid_c", "tmax_c").alias("c")).withColumn("m", none("double"))
    one = s.unionByName(med).agg(*[F.max(c).alias(c) for c in ("n_stations", "n_days", "e", "c", "m")])
    return one.select(
        "n_stations", "n_days", rnd("m").alias("median_bias"), rnd("e").alias("rmsd"), rnd("c").alias("r"),
        ((F.abs("m") <= 1.5) & (F.col("e") <= 2.5) & (F.col("c") >= 0.85)).alias("passed"))


@query("a31_peak_bracket", "v_stationgrid", """
SELECT round(max(grid_c), 2) AS grid_peak, max(tmax_c) AS station_peak, abs(round(max(grid_c), 2) - max(tmax_c)) <= 2.5 AS passed FROM v_stationgrid""")
def a31(spark, sf):
    return _station_grid(spark, sf).agg(rnd_scaled(F.max("grid_c"), 2).alias("grid_peak"), F.max("tmax_c").alias("station_peak")).withColumn(
        "passed", F.abs(F.col("grid_peak") - F.col("station_peak")) <= 2.5)


@query("a25_hour_set_residual", "v_temps", """
d AS (SELECT station, ts::DATE AS day, max(temp_c) - max(temp_c) FILTER (hour(ts) BETWEEN 6 AND 13) AS x FROM v_temps GROUP BY ALL)
SELECT station, round(avg(x), 4) AS mean_residual, round(quantile_cont(x, 0.99), 3) AS p99_residual, round(max(x), 3) AS max_residual FROM d GROUP BY 1""")
def a25(spark, sf):
    t = stations.parse_temps(X.v_obs(spark, sf))
    d = t.groupBy("station", F.to_date("ts").alias("day")).agg(
        (F.max("temp_c") - F.max(F.when(stations.observing_hours(F.col("ts")), F.col("temp_c")))).alias("x"))
    return d.groupBy("station").agg(rnd(F.avg("x"), 4).alias("mean_residual"), rnd(F.percentile("x", F.lit(0.99)), 3).alias("p99_residual"),
                                    rnd(F.max("x"), 3).alias("max_residual"))


@query("s13_station_inventory", "", """
SELECT s_suppkey AS station, (s_suppkey % 60)::DOUBLE AS lat, (s_suppkey % 90)::DOUBLE AS lon FROM supplier
WHERE s_nationkey % 3 = 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 60 BETWEEN 10 AND 40 AND s_suppkey % 90 BETWEEN 20 AND 80 AND s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0""")
def s13(spark, sf):
    s = X.table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    inv = s.select(
        F.col("s_suppkey").alias("station"), F.expr("case when s_nationkey % 3 = 0 then 'IN' else 'XX' end").alias("country"),
        F.expr("case when s_suppkey % 7 = 0 then 'n/a' else cast(s_suppkey % 60 as string) end").alias("lat"),
        F.expr("cast(s_suppkey % 90 as string)").alias("lon"),
        F.expr("case when s_suppkey % 4 = 0 then '20230101' else '19900101' end").alias("begin"),
        F.expr("case when s_suppkey % 5 = 0 then '20200101' else '20250101' end").alias("end"))
    return stations.station_inventory(inv, "IN", (20, 10, 80, 40), "20220401", "20220411").select("station", "lat", "lon")
