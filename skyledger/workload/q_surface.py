"""Surface temperature, archive items and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as K
from ..functions import geo
from ..operators import raster, surface
from ..sources import catalogue
from . import fixtures as X
from .registry import query, rnd

EVENT_YEAR = 2001

_LST = """
px AS (SELECT *, CASE WHEN raw <> 0 AND qc & 3 = 0 THEN raw * 0.02::DOUBLE END AS lst, ((dayofyear(day) - 1) // 8) * 8 + 1 AS period, year(day) AS yr FROM v_lst),
comp AS (SELECT * FROM px WHERE NOT daily), daily AS (SELECT * FROM px WHERE daily AND yr = 2001),
clim AS (SELECT tile, period, row, col, avg(lst) AS clim, count(DISTINCT CASE WHEN lst IS NOT NULL THEN yr END) AS n_years FROM comp WHERE yr < 2001 GROUP BY ALL)
"""


def _px(spark, sf):
    return X.v_lst(spark, sf).select(
        "tile", "day", "row", "col", "daily", "view_time", surface.masked_lst(F.col("raw"), F.col("qc")).alias("lst"),
        K.composite_start(F.col("day")).alias("period"), F.year("day").cast("bigint").alias("year"))


def _clim(spark, sf):
    return surface.composite_climatology(_px(spark, sf).where(~F.col("daily") & (F.col("year") < EVENT_YEAR)))


def _daily(spark, sf):
    return _px(spark, sf).where(F.col("daily") & (F.col("year") == EVENT_YEAR))


@query("p5_masked_lst", "v_lst", "WITH_PX SELECT tile, count(*) AS n, count(lst) AS n_valid, round(avg(lst), 6) AS mean_k FROM px GROUP BY 1".replace(
    "WITH_PX", "px AS (SELECT *, CASE WHEN raw <> 0 AND qc & 3 = 0 THEN raw * 0.02::DOUBLE END AS lst FROM v_lst)"))
def p5(spark, sf):
    return _px(spark, sf).groupBy("tile").agg(F.count("*").alias("n"), F.count("lst").alias("n_valid"), rnd(F.avg("lst")).alias("mean_k"))


@query("p6_thermal_calibration", "v_lst", "SELECT tile, round(avg(raw * 0.00341802::DOUBLE + 149.0::DOUBLE), 6) AS mean_k, round(max(raw * 0.00341802::DOUBLE + 149.0::DOUBLE), 6) AS max_k FROM v_lst GROUP BY 1")
def p6(spark, sf):
    k = surface.thermal_kelvin(F.col("raw"))
    return X.v_lst(spark, sf).groupBy("tile").agg(rnd(F.avg(k)).alias("mean_k"), rnd(F.max(k)).alias("max_k"))


@query("a33_lst_climatology", "v_lst", _LST + "SELECT tile, period, row, col, round(clim, 6) AS clim, n_years FROM clim")
def a33(spark, sf):
    return _clim(spark, sf).withColumn("clim", rnd("clim"))


_GRAN = _LST + """,
gr AS (SELECT d.tile, d.day, round_even(avg(CASE WHEN lst - clim IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 3) AS valid_frac, round_even(avg(lst - clim), 2) AS mean_anomaly FROM daily d JOIN clim USING (tile, period, row, col) GROUP BY ALL)
"""


@query("j8_daily_vs_climatology", "v_lst", _GRAN + "SELECT tile, day, valid_frac, mean_anomaly FROM gr")
def j8(spark, sf):
    return surface.granule_anomalies(_daily(spark, sf), _clim(spark, sf))


@query("a34_day_means", "v_lst", _GRAN + """
SELECT day, round_even(sum(mean_anomaly * floor(valid_frac * 1440000)) / greatest(sum(floor(valid_frac * 1440000)), 1), 2) AS anomaly, count(*) AS n_granules FROM gr WHERE mean_anomaly IS NOT NULL GROUP BY 1""")
def a34(spark, sf):
    return surface.day_means(surface.granule_anomalies(_daily(spark, sf), _clim(spark, sf)))


@query("j9_composite_residual", "v_lst", _LST + """,
dm AS (SELECT tile, period, row, col, avg(lst) AS d FROM daily GROUP BY ALL),
r AS (SELECT c.tile, c.period, avg(lst - d) AS residual FROM comp c JOIN dm USING (tile, period, row, col) WHERE yr = 2001 GROUP BY ALL)
SELECT tile, period, round(residual, 6) AS residual FROM r WHERE residual IS NOT NULL""")
def j9(spark, sf):
    comp = _px(spark, sf).where(~F.col("daily") & (F.col("year") == EVENT_YEAR))
    return surface.composite_residual(comp, _daily(spark, sf)).withColumn("residual", rnd("residual"))


_VIEW = """
vt AS (SELECT tile, day, avg(CASE WHEN view_time <> 255 THEN view_time * 0.1::DOUBLE END) AS v FROM v_lst WHERE daily AND year(day) = 2001 GROUP BY ALL)
"""


@query("a35_view_time", "v_lst", _VIEW + "SELECT tile, round(avg(v), 6) AS view_time_h, count(v) AS n_granules FROM vt GROUP BY 1")
def a35(spark, sf):
    return surface.mean_view_time(_daily(spark, sf), ["day"], ["tile"]).withColumn("view_time_h", rnd("view_time_h"))


@query("f17_overpass_hour", "v_lst", _VIEW + """
SELECT tile, CAST(((round_even(avg(v) - (60.0::DOUBLE + tile * 5) / 15, 0) % 24) + 24) % 24 AS BIGINT) AS hour_utc FROM vt GROUP BY 1""")
def f17(spark, sf):
    v = surface.mean_view_time(_daily(spark, sf), ["day"], ["tile"])
    return v.select("tile", K.overpass_hour_utc(F.col("view_time_h"), 60.0 + F.col("tile") * 5).alias("hour_utc"))


@query("j10_product_consistency", "v_lst v_land", _LST + "," + _VIEW + """,
oh AS (SELECT CAST(((round_even(avg(v) - 71.5::DOUBLE / 15, 0) % 24) + 24) % 24 AS BIGINT) AS hour FROM vt),
m AS (SELECT tile, day, avg(lst) AS k, count(lst) AS n FROM daily GROUP BY ALL HAVING count(lst) > 0), md AS (SELECT day, sum(k * n) / sum(n) AS k FROM m GROUP BY 1),
sk AS (SELECT l_shipdate::DATE AS day, l_orderkey % 24 AS hour, l_suppkey // 50 AS region_id, l_partkey % 4 AS lat_i, l_suppkey % 4 AS lon_i, avg(l_quantity) + 273.15::DOUBLE AS k FROM lineitem GROUP BY ALL),
g AS (SELECT day, hour, avg(sk.k) AS s FROM sk JOIN oh USING (hour) JOIN v_land USING (region_id, lat_i, lon_i) WHERE lsm > 0.5 GROUP BY ALL),
d AS (SELECT hour, k - s AS x FROM md JOIN g USING (day))
SELECT hour AS hour_utc, count(*) AS n_days, round(avg(x), 4) AS mean_diff, round(stddev_pop(x), 4) AS std_diff FROM d GROUP BY 1""")
def j10(spark, sf):
    daily = _daily(spark, sf)
    granules = daily.groupBy("tile", "day").agg(F.avg("lst").alias("k"), F.count("lst").alias("n"))
    hour = surface.mean_view_time(daily.withColumn("all", F.lit(1)), ["tile", "day"], ["all"]).select(K.overpass_hour_utc(F.col("view_time_h"), 71.5).alias("hour_utc"))
    li = X.table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])
    cell = [F.expr("l_suppkey div 50").alias("region_id"), F.expr("l_partkey % 4").alias("lat_i"), F.expr("l_suppkey % 4").alias("lon_i")]
    skin = li.groupBy(F.to_date("l_shipdate").alias("day"), F.expr("l_orderkey % 24").alias("hour"), *cell).agg((F.avg("l_quantity") + 273.15).alias("k"))
    skin = skin.join(X.v_land(spark, sf).select("region_id", "lat_i", "lon_i", "lsm"), ["region_id", "lat_i", "lon_i"])
    out = surface.skin_consistency(granules, skin, hour)
    return out.select("hour_utc", "n_days", rnd("mean_diff", 4).alias("mean_diff"), rnd("std_diff", 4).alias("std_diff"))


# ------------------------------------------------------------------ urban contrast

_UHI = """
fine AS (SELECT p_partkey, p_partkey % 40 AS ci, (p_partkey * 7) % 40 AS cj, CASE WHEN (p_partkey * 13) % 10 < 4 THEN 50 WHEN (p_partkey * 13) % 10 = 7 THEN 80 WHEN (p_partkey * 13) % 10 = 8 THEN 90 ELSE 10 END AS cls FROM part),
fr AS (SELECT ci, cj, avg(CASE WHEN cls = 50 THEN 1.0::DOUBLE ELSE 0 END) AS built, avg(CASE WHEN cls IN (80, 90) THEN 1.0::DOUBLE ELSE 0 END) AS waterwet FROM fine GROUP BY ALL),
lc AS (SELECT date_trunc('month', l_shipdate)::DATE AS day, (l_partkey) % 40 AS ci, (l_partkey * 7) % 40 AS cj, avg(l_quantity) AS lst FROM lineitem GROUP BY ALL),
cl AS (SELECT lc.*, built, waterwet, sqrt((ci * 2000.0::DOUBLE - 39000) ** 2 + (cj * 2000.0::DOUBLE - 39000) ** 2) / 1000 AS dist FROM lc JOIN fr USING (ci, cj)),
pa AS (SELECT * FROM (VALUES ('central', 0.5::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE), ('low', 0.3, 20, 40), ('ring', 0.5, 25, 45)) t(param, uf, r0, r1)),
uh AS (SELECT param, day, avg(lst) FILTER (built >= uf AND dist <= 20) AS u, avg(lst) FILTER (built <= 0.1 AND waterwet < 0.5 AND dist BETWEEN r0 AND r1) AS r, count(lst) FILTER (built >= uf AND dist <= 20) AS n_urban,
 count(lst) FILTER (built <= 0.1 AND waterwet < 0.5 AND dist BETWEEN r0 AND r1) AS n_rural FROM cl, pa GROUP BY ALL),
uk AS (SELECT param, day, CASE WHEN n_urban >= 10 AND n_rural >= 30 THEN round_even(u - r, 2) END AS uhi_k, n_urban, n_rural FROM uh)
"""


def _fractions(spark, sf):
    p = X.table(spark, sf, "part", ["p_partkey"])
    cls = F.expr("case when (p_partkey * 13) % 10 < 4 then 50 when (p_partkey * 13) % 10 = 7 then 80 when (p_partkey * 13) % 10 = 8 then 90 else 10 end")
    fine = p.select(F.expr("p_partkey % 40").alias("ci"), F.expr("(p_partkey * 7) % 40").alias("cj"), cls.alias("cls"))
    return raster.class_fractions(fine, ["ci", "cj"], F.col("cls"), {"built": [50], "waterwet": [80, 90]})


def _uhi(spark, sf):
    li = X.table(spark, sf, "lineitem", ["l_partkey", "l_shipdate", "l_quantity"])
    lc = li.groupBy(F.trunc("l_shipdate", "month").alias("day"), F.expr("l_partkey % 40").alias("ci"), F.expr("(l_partkey * 7) % 40").alias("cj")).agg(F.avg("l_quantity").alias("lst"))
    cells = lc.join(_fractions(spark, sf), ["ci", "cj"]).withColumn("dist_km", geo.planar_km(F.col("ci") * 2000.0, F.col("cj") * 2000.0, 39000.0, 39000.0))
    params = F.array(*[F.struct(F.lit(n).alias("param"), F.lit(u).alias("urban_frac"), F.lit(a).alias("ring0"), F.lit(b).alias("ring1"))
                       for n, u, a, b in (("central", 0.5, 20.0, 40.0), ("low", 0.3, 20.0, 40.0), ("ring", 0.5, 25.0, 45.0))])
    return surface.urban_contrast(cells.withColumn("p", F.explode(params)).select("*", "p.*"), ["param", "day"])


@query("a37_class_fractions", "", "WITH " + _UHI + "SELECT ci, cj, round(built, 6) AS built, round(waterwet, 6) AS waterwet FROM fr")
def a37(spark, sf):
    return _fractions(spark, sf).select("ci", "cj", rnd("built").alias("built"), rnd("waterwet").alias("waterwet"))


@query("a36_urban_contrast", "", "WITH " + _UHI + "SELECT param, day, uhi_k, n_urban, n_rural FROM uk")
def a36(spark, sf):
    return _uhi(spark, sf)


@query("a38_uhi_summary", "", "WITH " + _UHI + "SELECT param, count(uhi_k) AS n_days, round(avg(uhi_k), 4) AS mean_uhi, round(stddev_pop(uhi_k), 4) AS std_uhi FROM uk GROUP BY 1")
def a38(spark, sf):
    return _uhi(spark, sf).groupBy("param").agg(F.count("uhi_k").alias("n_days"), rnd(F.avg("uhi_k"), 4).alias("mean_uhi"), rnd(F.stddev_pop("uhi_k"), 4).alias("std_uhi"))


@query("f18_planar_distance", "", "SELECT p_partkey, round(sqrt((p_size * 1000.0::DOUBLE - 25000) ** 2 + (p_retailprice - 1000) ** 2) / 1000, 6) AS dist_km FROM part")
def f18(spark, sf):
    p = X.table(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice"])
    return p.select("p_partkey", rnd(geo.planar_km(F.col("p_size") * 1000.0, F.col("p_retailprice"), 25000.0, 1000.0)).alias("dist_km"))


# ------------------------------------------------------------------ items


@query("f13_item_calendar", "v_items", """
SELECT o_orderkey, split_part(item_id, '.', 3) AS tile, day AS item_day, dayofyear(day)::BIGINT AS doy, ((dayofyear(day) - 1) // 8) * 8 + 1 AS composite FROM v_items""")
def f13(spark, sf):
    i = F.col("item_id")
    return X.v_items(spark, sf).select("o_orderkey", K.item_tile(i).alias("tile"), K.item_day(i).alias("item_day"), K.item_doy(i).alias("doy"),
                                       K.composite_start(K.item_day(i)).alias("composite"))


@query("s11_dedupe_latest", "v_items", """
SELECT item_key, max(item_id) AS item_id, count(*) AS n_versions FROM (SELECT item_id, array_to_string(string_split(item_id, '.')[1:4], '.') AS item_key FROM v_items) GROUP BY 1""")
def s11(spark, sf):
    i = X.v_items(spark, sf)
    n = i.groupBy(catalogue.stable_item(F.col("item_id")).alias("item_key")).agg(F.count("*").alias("n_versions"))
    return catalogue.dedupe_latest(i.select("item_id")).join(n, "item_key")


_ITEMKEY = "split_part(item_id, '.061', 1) || '.061'"


@query("s10_asset_map", "v_items", f"""
a AS (SELECT DISTINCT {_ITEMKEY} AS item_id, asset FROM v_items WHERE starts_with(item_id, 'MOD11'))
SELECT item_id, list(asset ORDER BY asset) AS assets, count(*) AS n_assets FROM a GROUP BY 1""")
def s10(spark, sf):
    files = X.v_items(spark, sf).select(F.concat(F.lit("/archive/modis/"), catalogue.stable_item(F.col("item_id")), F.lit("_"), "asset", F.lit(".tif")).alias("path"))
    m = catalogue.collect_assets(files, "MOD11", ["LST_Day_1km", "QC_Day", "Day_view_time"])
    return m.select("item_id", F.array_sort(F.map_keys("assets")).alias("assets"), F.size("assets").cast("bigint").alias("n_assets"))


@query("u5_missing_assets", "v_items", f"""
i AS (SELECT DISTINCT {_ITEMKEY} AS item_id FROM v_items), a AS (SELECT DISTINCT {_ITEMKEY} AS item_id, asset FROM v_items)
SELECT item_id, asset FROM i, (SELECT unnest(['LST_Day_1km', 'QC_Day']) AS asset) EXCEPT SELECT item_id, asset FROM a""")
def u5(spark, sf):
    a = X.v_items(spark, sf).select(catalogue.stable_item(F.col("item_id")).alias("item_id"), "asset").distinct()
    return catalogue.missing_assets(a.select("item_id").distinct(), a, ["LST_Day_1km", "QC_Day"])
