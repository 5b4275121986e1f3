"""Domain views over the driver tables, defined for Spark and as SQL twins.

Every view is arithmetic on the given rows and grows with them: scenes,
regions, stations, wedges and items are keyed by ranges of the table keys.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stencil import dense_raster
from ..session import apply_runtime_conf, tasks_for

SIDE = 48
SCENE_ORDERS = 7500
BASE_YEARS = (1995, 2000)
EVENT_YEAR = 2001


def table(spark: SparkSession, sf: str, name: str, cols: list[str] | None = None) -> DataFrame:
    apply_runtime_conf(spark)
    df = spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
    return df.select(*cols) if cols else df


# ---------------------------------------------------------------- gridded days


def grid_tasks(spark, sf):
    """Tasks among which the cells of the grid are dealt out."""
    return tasks_for(table(spark, sf, "lineitem"))


def v_grid(spark, sf, tasks=None):
    """One row per cell and day; with ``tasks`` cells are dealt out to so many, and what follows per cell needs no other exchange."""
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])
    rows = li.select(
        F.expr("l_suppkey div 50").alias("region_id"),
        F.expr("l_partkey % 4").alias("lat_i"),
        F.expr("l_suppkey % 4").alias("lon_i"),
        F.to_date("l_shipdate").alias("day"),
        "l_quantity",
    )
    if tasks:
        rows = rows.repartition(tasks, "region_id", "lat_i", "lon_i")
    return (
        rows.groupBy("region_id", "lat_i", "lon_i", "day")
        .agg(F.max("l_quantity").alias("tmax"))
        .withColumn("lat", 22.0 + F.col("lat_i"))
        .withColumn("lon", 70.0 + F.col("lon_i"))
    )


def v_days(spark, sf):
    """v_grid on a common-year axis: 29 February dropped, ``year`` and ``day_idx`` added."""
    from ..functions.calendar import common_year_index

    g = v_grid(spark, sf, grid_tasks(spark, sf))
    return (
        g.withColumn("day_idx", common_year_index(F.col("day")))
        .where(F.col("day_idx").isNotNull())
        .withColumn("year", F.year("day").cast("bigint"))
    )


def v_land(spark, sf):
    g = v_grid(spark, sf).select("region_id", "lat_i", "lon_i", "lat", "lon").distinct()
    return g.withColumn("lsm", F.when(F.expr("(lat_i * 5 + lon_i * 3) % 7 = 0"), 0.3).otherwise(0.9))


def v_second(spark, sf):
    """A second gridded product on the same cells: 0.9 of the value plus a cell term, with gaps."""
    g = v_days(spark, sf)
    return g.where(F.expr("(lat_i * 7 + lon_i * 3 + day_idx) % 11 <> 0")).withColumn(
        "tmax", F.col("tmax") * 0.9 + (F.col("lat_i") - F.col("lon_i")) * 0.25 + 4.0
    )


# ---------------------------------------------------------------- stations


def v_obs(spark, sf):
    e = table(spark, sf, "events", ["event_id", "user_id", "ts", "value"])
    tenths = F.expr("cast(round(value * 100) as bigint) % 700 - 100")
    text = F.concat(
        F.when(tenths < 0, "-").otherwise("+"), F.lpad(F.abs(tenths).cast("string"), 4, "0"),
        F.lit(","), F.expr("cast(event_id % 10 as string)"),
    )
    return e.select(
        F.expr("user_id div 15").alias("station"), F.col("ts"),
        F.when(F.expr("event_id % 97 = 5"), F.lit("+9999,1"))
        .when(F.expr("event_id % 101 = 7"), F.lit("broken"))
        .when(F.expr("event_id % 103 = 9"), F.lit("+9x99,1")).otherwise(text).alias("tmp"),
        "event_id",
    )


# ---------------------------------------------------------------- rasters


def v_extent(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey"])
    return li.select(F.expr(f"l_orderkey div {SCENE_ORDERS}").alias("scene_id")).distinct().select(
        "scene_id", F.lit(SIDE).cast("bigint").alias("ny"), F.lit(SIDE).cast("bigint").alias("nx"),
        (53.0 + F.col("scene_id") * 0.5).alias("lon0"), F.lit(39.5).alias("lat0"),
        F.lit(0.01).alias("dlon"), F.lit(-0.01).alias("dlat"),
    )


def v_raster(spark, sf):
    """Dense own/reference rasters with two bright features and missing pixels."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"])
    cells = (
        li.select(
            F.expr(f"l_orderkey div {SCENE_ORDERS}").alias("scene_id"),
            F.expr(f"l_orderkey % {SIDE}").alias("r"), F.expr(f"l_partkey % {SIDE}").alias("c"),
            F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"),
            F.expr("cast(l_quantity as bigint)").alias("qty"),
        )
        .groupBy("scene_id", "r", "c")
        .agg(F.sum("cents").alias("s"), F.sum("qty").alias("q"), F.count("*").alias("n"))
    )
    bump = F.expr(
        "greatest(0, 360 - 40 * (abs(r - 14) + abs(c - (12 + scene_id % 5)))) + "
        "greatest(0, 240 - 30 * (abs(r - 33) + abs(c - 35)))"
    )
    gone = F.expr("(7 * r + 3 * c) % 29 = 0")
    full = dense_raster(cells, v_extent(spark, sf), ["s", "q", "n"])
    return full.select(
        "scene_id", "r", "c", "ny", "nx",
        (F.col("lon0") + F.col("c") * F.col("dlon")).alias("lon"),
        (F.col("lat0") + F.col("r") * F.col("dlat")).alias("lat"),
        F.when(~gone, F.expr("s / n / 100000.0") + bump).alias("own"),
        F.when(~gone & F.expr("(r + c) % 31 <> 0"), F.expr("q / n * 2.0") + bump * 0.7).alias("ref"),
    )


def v_glt(spark, sf):
    ext = v_extent(spark, sf)
    i = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    g = ext.select("scene_id", i(SIDE).alias("oy")).select("scene_id", "oy", i(SIDE).alias("ox"))
    return g.select(
        "scene_id", "oy", "ox", F.expr("(ox * 5 + oy) % 51").alias("glt_x"), F.expr("(oy * 7 + ox) % 50").alias("glt_y")
    )


def v_mask(spark, sf):
    """A 0/1 mask of scattered shapes for region operators."""
    r = v_raster(spark, sf)
    return r.where(F.col("own").isNotNull() & (F.col("own") > 60.0)).select("scene_id", "r", "c", "own", "ref", "lon", "lat")


# ---------------------------------------------------------------- spectra


def v_bands(spark, sf):
    scenes = table(spark, sf, "embeddings", ["vec_id"]).select(F.expr("vec_id div 500").alias("scene_id")).distinct()
    return scenes.select(
        "scene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("band")
    ).select(
        "scene_id", "band", (2000.0 + 12.5 * F.col("band")).alias("wl"), F.lit(8.5).alias("fwhm"),
        F.expr("-(1.0D + (band * 7) % 5) / 1000.0D").alias("k"),
    )


def v_pixels(spark, sf):
    e = table(spark, sf, "embeddings", ["vec_id", "label", "embedding"])
    return e.select(
        F.expr("vec_id div 500").alias("scene_id"), F.col("vec_id").alias("line"),
        F.expr("cast(label as bigint) % 4").alias("xtrack"),
        F.expr("transform(embedding, x -> 2.0D + cast(x as double))").alias("rad"),
        F.expr("array(0, 0, 0, 0, case when vec_id % 13 = 0 then 1 else 0 end, 0, cast(vec_id % 3 as int))").alias("flags"),
    ).withColumn("bad", F.get("flags", F.lit(4)) != 0)


def v_hires(spark, sf):
    """Fine spectral grid per scene: part keys spread over 2100-2500 nm."""
    p = table(spark, sf, "part", ["p_partkey", "p_size"])
    return p.select(
        F.expr("p_partkey div 2000").alias("scene_id"),
        (2100.0 + F.expr("p_partkey % 2000") * 0.2 + F.expr("(p_partkey * 7) % 3") * 0.01).alias("nm"),
        (F.col("p_size") * 1e-22).alias("kx"),
    )


def v_hbands(spark, sf):
    p = table(spark, sf, "part", ["p_partkey"])
    return p.select(F.expr("p_partkey div 2000").alias("scene_id")).distinct().select(
        "scene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("band")
    ).select("scene_id", "band", (2100.0 + 10.0 * F.col("band")).alias("wl"), (8.0 + F.expr("band % 3")).alias("fwhm"))


# ---------------------------------------------------------------- weather


def v_weather(spark, sf):
    e = table(spark, sf, "events", ["event_id", "user_id", "ts", "value"])
    return (
        e.select(
            F.expr("user_id div 15").alias("station"), F.date_trunc("HOUR", "ts").alias("hour_ts"),
            F.expr("cast(round(value * 100) as bigint)").alias("cents"), F.expr("event_id % 21 - 10").alias("w"),
        )
        .groupBy("station", "hour_ts")
        .agg(F.sum("cents").alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
        .select(
            F.expr("station % 20").alias("cell_i"), F.expr("station div 20").alias("cell_j"),
            F.expr("10.0D + 0.25D * (station % 20)").alias("glat"),
            F.expr("350.0D + 0.25D * (station div 20)").alias("glon"),
            F.unix_seconds(F.col("hour_ts").cast("timestamp")).alias("ts"),
            F.expr("s / n / 1000.0D").alias("u"), F.expr("cast(w as double) / n").alias("v"),
            F.expr("95000.0D + 100.0D * n").alias("sp"), F.expr("280.0D + s / n / 10000.0D").alias("t2m"),
        )
    )


def v_overpass(spark, sf):
    """Requests at exact event times near station cells, on the -180..180 convention."""
    e = table(spark, sf, "events", ["event_id", "user_id", "ts"])
    return e.select(
        F.col("event_id").alias("request_id"),
        F.expr("10.0D + 0.25D * ((user_id div 15) % 20) + (event_id % 7 - 3) * 0.03D").alias("lat"),
        F.expr("-10.0D + 0.25D * ((user_id div 15) div 20) + (event_id % 5 - 2) * 0.04D").alias("lon"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
    )


# ---------------------------------------------------------------- features


def v_points(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_name", "c_acctbal"])
    s = table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"])

    def place(df, key, layer, name, bal):
        return df.select(
            layer.alias("layer"), key.alias("feature_id"),
            F.expr("-20.0D + (k * 37 % 3600) / 90.0D").alias("lon"),
            F.expr("20.0D + (k * 53 % 1200) / 40.0D").alias("lat"), name.alias("name"), bal.alias("bal"),
        )

    a = c.withColumn("k", F.col("c_custkey"))
    b = s.withColumn("k", F.col("s_suppkey") * 11 + 3)
    one = place(a, F.col("c_custkey"), F.col("c_mktsegment"), F.concat(F.lit("LEASE "), F.expr("cast(c_custkey % 40 as string)"), F.lit(" #"), F.col("c_custkey").cast("string")), F.col("c_acctbal"))
    two = place(b, F.col("s_suppkey") + 1000000000, F.lit("FACILITY"), F.col("s_name"), F.col("s_acctbal"))
    return one.unionByName(two)


def v_wedges(spark, sf):
    s = table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"])
    return s.select(
        F.col("s_suppkey").alias("event_id"),
        F.expr("-20.0D + (s_suppkey * 71 % 360) / 9.0D").alias("apex_lon"),
        F.expr("20.0D + (s_suppkey * 29 % 120) / 4.0D").alias("apex_lat"),
        F.expr("(s_suppkey % 9 - 4) * 1.0D + 0.5D").alias("u"), F.expr("(s_suppkey % 7 - 3) * 1.0D + 0.25D").alias("v"),
        F.expr("0.5D + (s_suppkey % 5) * 0.5D").alias("sigma"), F.lit(2.5).alias("u_eff"),
        F.expr("1000.0D + 10.0D * (s_suppkey % 50)").alias("length_m"),
    )


def v_polys(spark, sf):
    """Notched five-sided fields, one per supplier."""
    s = table(spark, sf, "supplier", ["s_suppkey"])
    p = "named_struct('lon', x + {0}, 'lat', y + {1})"
    pts = ", ".join(
        p.format(a, b)
        for a, b in (("-2.0D", "-1.0D"), ("2.0D", "-1.0D"), ("2.0D", "1.0D"), ("0.25D", "-0.25D"), ("-2.0D", "1.0D"), ("-2.0D", "-1.0D"))
    )
    return s.select(
        F.col("s_suppkey").alias("poly_id"),
        F.expr("-20.0D + (s_suppkey * 71 % 360) / 9.0D").alias("x"),
        F.expr("20.0D + (s_suppkey * 29 % 120) / 4.0D").alias("y"),
    ).select("poly_id", "x", "y", F.expr(f"array(array({pts}))").alias("rings"))


# ---------------------------------------------------------------- evaluation


def v_events(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("event_id"), F.col("n_name").alias("name"),
        F.when(F.expr("n_nationkey % 4 = 3"), "heat_wave").when(F.expr("n_nationkey % 4 = 2"), "flood").otherwise("emission").alias("phenomenon"),
        F.expr("n_nationkey % 4 = 3").alias("is_area"),
        F.expr("case when n_nationkey % 3 = 0 then array('1-URGENT', '2-HIGH') else array('1-URGENT', '3-MEDIUM', '5-LOW') end").alias("expected_types"),
        F.expr("timestamp_ntz'1995-06-01 00:00:00' + make_dt_interval(cast(n_nationkey * 40 as int))").alias("e_t0"),
        F.expr("case when n_nationkey % 5 <> 4 then timestamp_ntz'1995-06-01 00:00:00' + make_dt_interval(cast(n_nationkey * 40 + 900 as int)) end").alias("e_t1"),
        F.expr("10.0D + n_nationkey").alias("e_lon"), F.expr("20.0D + n_nationkey * 0.5D").alias("e_lat"),
        F.expr("case when n_nationkey % 2 = 0 then 10.0D + n_nationkey end").alias("precision_km"),
        F.expr("named_struct('min_lon', 9.5D + n_nationkey, 'min_lat', 19.75D + n_nationkey * 0.5D, 'max_lon', 10.5D + n_nationkey, 'max_lat', 20.25D + n_nationkey * 0.5D)").alias("e_box"),
        F.expr("case when n_nationkey % 3 <> 1 then concat('ACQ', n_nationkey) end").alias("acquisition"),
        F.expr("n_nationkey % 6 <> 5").alias("has_recipe"),
    )


def v_dets(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"])
    ev = "(o_custkey % 25)"
    return o.select(
        F.col("o_orderkey").alias("det_id"), F.expr(ev).alias("event_id"), F.col("o_orderpriority").alias("type"),
        F.expr(f"10.0D + {ev} + (o_orderkey % 17 - 8) * 0.01D").alias("lon"),
        F.expr(f"20.0D + {ev} * 0.5D + (o_orderkey % 13 - 6) * 0.01D").alias("lat"),
        F.col("o_orderdate").alias("t0"),
        F.expr("case when o_orderkey % 3 = 0 then o_orderdate + make_dt_interval(2) end").alias("t1"),
        F.expr(
            f"case when o_orderkey % 4 <> 0 then named_struct('min_lon', 9.5D + {ev} + (o_orderkey % 11) * 0.1D, 'min_lat', 19.75D + {ev} * 0.5D + (o_orderkey % 7) * 0.05D, "
            f"'max_lon', 10.2D + {ev} + (o_orderkey % 11) * 0.1D, 'max_lat', 20.15D + {ev} * 0.5D + (o_orderkey % 7) * 0.05D) end"
        ).alias("footprint"),
        F.expr("map('rate', o_totalprice / 1000.0D, 'mass', cast(o_orderkey % 50 as double))").alias("measurements"),
    )


def v_refs(spark, sf):
    """Reference measurements of each event with their usability."""
    n = table(spark, sf, "nation", ["n_nationkey"])
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("event_id"),
        F.explode(
            F.expr(
                "array(named_struct('name', 'rate', 'value', 100.0D + n_nationkey, 'usability', case when n_nationkey % 3 = 0 then 'scope_mismatch' else 'comparable' end, 'why', case when n_nationkey % 3 = 0 then concat('cluster total ', n_nationkey) end),"
                "named_struct('name', 'mass', 'value', case when n_nationkey % 7 = 0 then 0.0D else 20.0D end, 'usability', 'comparable', 'why', cast(null as string)))"
            )
        ).alias("m"),
    ).select("event_id", "m.*")


def v_runs(spark, sf):
    n = table(spark, sf, "nation", ["n_nationkey"])
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("event_id"),
        F.expr("case when n_nationkey % 8 = 7 then 'not_runnable' when n_nationkey % 11 = 10 then 'error' else 'ran' end").alias("status"),
        F.expr("n_nationkey * 0.5D + 1.0D").alias("latency_s"),
    )


# ---------------------------------------------------------------- items


def v_items(spark, sf):
    """Archive items with reprocessed duplicates and a companion product."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return o.select(
        F.col("o_orderkey"),
        F.concat(
            F.when(F.expr("o_orderkey % 5 = 4"), "MYD11A1").otherwise("MOD11A1"), F.lit(".A"),
            F.date_format("o_orderdate", "yyyy"), F.lpad(F.dayofyear("o_orderdate").cast("string"), 3, "0"),
            F.lit(".h"), F.lpad(F.expr("o_custkey div 100").cast("string"), 2, "0"), F.lit("v0"), F.expr("cast(o_custkey % 3 as string)"),
            F.lit(".061."), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"),
        ).alias("item_id"),
        F.expr("case o_orderkey % 3 when 0 then 'LST_Day_1km' when 1 then 'QC_Day' else 'Day_view_time' end").alias("asset"),
        F.to_date("o_orderdate").alias("day"),
    )


def v_lst(spark, sf):
    """Surface-temperature pixels: daily (A1) and composite (A2) raw values with QC."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_linenumber"])
    return li.select(
        F.expr("l_suppkey div 25").alias("tile"), F.to_date("l_shipdate").alias("day"),
        F.expr("l_partkey % 6").alias("row"), F.expr("l_suppkey % 6").alias("col"),
        F.expr("case when l_orderkey % 37 = 0 then 0 else cast(14000 + l_extendedprice / 50 as bigint) end").alias("raw"),
        F.expr("l_orderkey % 8").alias("qc"), F.expr("l_linenumber % 2 = 1").alias("daily"),
        F.expr("case when l_orderkey % 19 = 0 then 255 else 95 + l_orderkey % 20 end").alias("view_time"),
    )


def v_scores(spark, sf):
    p = table(spark, sf, "part", ["p_partkey", "p_size", "p_brand"])
    return p.select(
        F.expr("p_partkey div 60").alias("event_id"), F.expr("(p_partkey div 3) % 20").alias("cand"),
        F.expr("element_at(array('spatial', 'type', 'magnitude'), cast(p_partkey % 3 as int) + 1)").alias("component"),
        (F.col("p_size") / 50.0).alias("value"),
        F.expr("element_at(array(0.60D, 0.25D, 0.15D), cast(p_partkey % 3 as int) + 1)").alias("weight"),
    )


# ---------------------------------------------------------------- SQL twins

SQL: dict[str, str] = {
    "v_grid": """SELECT l_suppkey // 50 AS region_id, l_partkey % 4 AS lat_i, l_suppkey % 4 AS lon_i, l_shipdate::DATE AS day,
  max(l_quantity) AS tmax, 22.0::DOUBLE + l_partkey % 4 AS lat, 70.0::DOUBLE + l_suppkey % 4 AS lon
  FROM lineitem GROUP BY ALL""",
    "v_days": """SELECT *, [0,31,59,90,120,151,181,212,243,273,304,334][month(day)]::BIGINT + day(day) - 1 AS day_idx, year(day) AS year
  FROM v_grid WHERE NOT (month(day) = 2 AND day(day) = 29)""",
    "v_land": """SELECT DISTINCT region_id, lat_i, lon_i, lat, lon, CASE WHEN (lat_i * 5 + lon_i * 3) % 7 = 0 THEN 0.3::DOUBLE ELSE 0.9 END AS lsm FROM v_grid""",
    "v_second": """SELECT * REPLACE (tmax * 0.9::DOUBLE + (lat_i - lon_i) * 0.25::DOUBLE + 4.0::DOUBLE AS tmax) FROM v_days
  WHERE (lat_i * 7 + lon_i * 3 + day_idx) % 11 <> 0""",
    "v_variants": "SELECT * FROM (VALUES ('central',1995,2000,10),('early',1995,1997,10),('late',1998,2000,10),('wide',1995,2000,15)) t(variant,y0,y1,h)",
    "v_clim": """SELECT p.variant, e.region_id, e.lat_i, e.lon_i, e.day_idx, e.tmax, sum(b.tmax) / count(b.tmax) AS clim, count(b.tmax) AS clim_n
  FROM (SELECT * FROM v_days, v_variants WHERE year = 2001 AND day_idx BETWEEN h AND 364 - h) e LEFT JOIN v_days b ON b.region_id = e.region_id AND b.lat_i = e.lat_i
  AND b.lon_i = e.lon_i AND b.year BETWEEN e.y0 AND e.y1 AND b.day_idx BETWEEN e.day_idx - e.h AND e.day_idx + e.h JOIN v_variants p ON p.variant = e.variant GROUP BY ALL""",
    "v_lane": """SELECT c.*, lat, lon, (6371.0088::DOUBLE * pi() / 180) ** 2 * cos(radians(lat)) AS area, tmax - clim AS anomaly,
  coalesce(tmax + 273.15::DOUBLE >= 313.15::DOUBLE AND (tmax + 273.15::DOUBLE) - (clim + 273.15::DOUBLE) >= 4.5::DOUBLE, false) AS hot
  FROM v_clim c JOIN v_land USING (region_id, lat_i, lon_i) WHERE lsm > 0.5""",
    "v_landtotal": """SELECT region_id, sum((6371.0088::DOUBLE * pi() / 180) ** 2 * cos(radians(lat))) AS land_area, sum(cos(radians(lat))) AS w FROM v_land WHERE lsm > 0.5 GROUP BY 1""",
    "v_laned": """SELECT region_id, variant, day_idx, sum(CASE WHEN hot THEN area ELSE 0 END) AS extent_km2, sum(anomaly * area) / sum(CASE WHEN anomaly IS NOT NULL THEN area END) AS mean_anomaly,
  max(anomaly) AS peak_anomaly, max(tmax) AS peak_tmax, sum(CASE WHEN hot THEN area ELSE 0 END) / any_value(land_area) AS area_frac
  FROM v_lane JOIN v_landtotal USING (region_id) GROUP BY ALL""",
    "v_pool": """SELECT e.region_id, e.lat_i, e.lon_i, e.day_idx, quantile_cont(b.tmax, 0.95) AS pctl, sum(b.tmax) / count(*) AS mean_pool, count(*) AS n_pool
  FROM (SELECT DISTINCT region_id, lat_i, lon_i, unnest(range(365)) AS day_idx FROM v_land) e JOIN v_days b ON b.region_id = e.region_id AND b.lat_i = e.lat_i
  AND b.lon_i = e.lon_i AND b.year BETWEEN 1995 AND 2000 AND b.day_idx BETWEEN e.day_idx - 10 AND e.day_idx + 10 GROUP BY ALL""",
    "v_temps": """SELECT station, ts, event_id, TRY_CAST(ltrim(split_part(tmp, ',', 1), '+') AS INTEGER) / 10.0::DOUBLE AS temp_c FROM v_obs
  WHERE contains(tmp, ',') AND split_part(tmp, ',', 1) <> '+9999' AND trim(split_part(tmp, ',', 2)) IN ('0','1','4','5','9')
  AND TRY_CAST(ltrim(split_part(tmp, ',', 1), '+') AS INTEGER) / 10.0::DOUBLE BETWEEN -40 AND 55""",
    "v_stationmax": """SELECT station, ts::DATE AS day, max(temp_c) AS tmax_c, count(*) AS n_obs, arg_min(hour(ts), {'a': -temp_c, 'b': ts})::BIGINT AS hour_of_max
  FROM v_temps WHERE hour(ts) BETWEEN 6 AND 13 GROUP BY ALL HAVING count(*) >= 4""",
    "v_stationgrid": """SELECT s.station, s.day, s.tmax_c, w.t2m - 273.15::DOUBLE + 5.0::DOUBLE AS grid_c FROM v_stationmax s JOIN (SELECT station, to_timestamp(ts)::TIMESTAMP::DATE AS day, max(t2m) * 1.0 AS t2m FROM
  (SELECT cell_i + 20 * cell_j AS station, ts, t2m FROM v_weather) GROUP BY ALL) w USING (station, day)""",
    "v_obs": """SELECT user_id // 15 AS station, ts, event_id, CASE WHEN event_id % 97 = 5 THEN '+9999,1' WHEN event_id % 101 = 7 THEN 'broken'
  WHEN event_id % 103 = 9 THEN '+9x99,1' ELSE
  (CASE WHEN round(value * 100)::BIGINT % 700 - 100 < 0 THEN '-' ELSE '+' END) || lpad(abs(round(value * 100)::BIGINT % 700 - 100)::VARCHAR, 4, '0')
  || ',' || (event_id % 10)::VARCHAR END AS tmp FROM events""",
    "v_extent": f"""SELECT DISTINCT l_orderkey // {SCENE_ORDERS} AS scene_id, {SIDE}::BIGINT AS ny, {SIDE}::BIGINT AS nx,
  53.0::DOUBLE + (l_orderkey // {SCENE_ORDERS}) * 0.5::DOUBLE AS lon0, 39.5::DOUBLE AS lat0, 0.01::DOUBLE AS dlon, -0.01::DOUBLE AS dlat FROM lineitem""",
    "v_raster": f"""SELECT g.scene_id, g.r, g.c, ny, nx, lon0 + g.c * dlon AS lon, lat0 + g.r * dlat AS lat,
  CASE WHEN (7 * g.r + 3 * g.c) % 29 <> 0 THEN s::DOUBLE / n / 100000.0::DOUBLE + bump END AS own,
  CASE WHEN (7 * g.r + 3 * g.c) % 29 <> 0 AND (g.r + g.c) % 31 <> 0 THEN q::DOUBLE / n * 2.0::DOUBLE + bump * 0.7::DOUBLE END AS ref
  FROM (SELECT *, greatest(0, 360 - 40 * (abs(r - 14) + abs(c - (12 + scene_id % 5)))) + greatest(0, 240 - 30 * (abs(r - 33) + abs(c - 35))) AS bump
        FROM (SELECT v_extent.*, unnest(range({SIDE})) AS r FROM v_extent) , (SELECT unnest(range({SIDE})) AS c)) g
  LEFT JOIN (SELECT l_orderkey // {SCENE_ORDERS} AS scene_id, l_orderkey % {SIDE} AS r, l_partkey % {SIDE} AS c,
        sum(round(l_extendedprice * 100)::BIGINT) AS s, sum(l_quantity::BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL) a
  ON a.scene_id = g.scene_id AND a.r = g.r AND a.c = g.c""",
    "v_box": """SELECT *, lon BETWEEN 53.0::DOUBLE + scene_id * 0.5::DOUBLE + 0.035::DOUBLE AND 53.0::DOUBLE + scene_id * 0.5::DOUBLE + 0.245::DOUBLE AND lat BETWEEN 39.235 AND 39.465 AS inside,
  0.01::DOUBLE * 0.01::DOUBLE * 111319.49079327357::DOUBLE ** 2 * cos(radians(lat)) AS area_m2, (100000.0::DOUBLE + 10 * scene_id) / (8.314462618::DOUBLE * 300) AS n_air,
  3.0::DOUBLE + scene_id % 3 AS u10, 1.7::DOUBLE AS u10_sigma FROM v_raster""",
    "v_foot": """SELECT v_box.*, thr, own AS enh FROM v_box, (SELECT unnest([60.0::DOUBLE, 100.0, 150.0, 200.0, 900.0]) AS thr) WHERE inside AND own IS NOT NULL AND ref > thr""",
    "v_quant": """SELECT scene_id, thr, count(*) AS n_px, coalesce(sum(enh * 1e-6::DOUBLE * 0.01604::DOUBLE * area_m2), 0) * any_value(n_air) AS ime_kg, sum(area_m2) AS area_m2, sqrt(sum(area_m2)) AS length_m,
  any_value(u10) AS u10, ln(any_value(u10)) + 0.6::DOUBLE AS u_eff,
  (ln(any_value(u10)) + 0.6::DOUBLE) * (coalesce(sum(enh * 1e-6::DOUBLE * 0.01604::DOUBLE * area_m2), 0) * any_value(n_air)) / sqrt(sum(area_m2)) * 3.6::DOUBLE AS q_t_h,
  sqrt((ln(any_value(u10)) * 0.1::DOUBLE) ** 2 + (1 / any_value(u10) * 1.7::DOUBLE) ** 2) / (ln(any_value(u10)) + 0.6::DOUBLE) AS wind_total,
  avg(lon) AS clon, avg(lat) AS clat, sum(own * area_m2) / sum(ref * area_m2) AS bias, avg(own) / avg(ref) AS bias_mean FROM v_foot GROUP BY ALL""",
    "v_nbr": """SELECT a.scene_id, a.r, a.c, count(b.own) AS n_local, sum(b.own) / count(b.own) AS mean_local,
  greatest((sum(b.own * b.own) - count(b.own) * (sum(b.own) / count(b.own)) ** 2) / greatest(count(b.own) - 1, 1), 0) AS var_local, any_value(a.own) AS own
  FROM (SELECT scene_id, r, c, own, CASE WHEN r + dr < 0 THEN -1 - r - dr WHEN r + dr > 47 THEN 95 - r - dr ELSE r + dr END AS rr, CASE WHEN c + dc < 0 THEN -1 - c - dc WHEN c + dc > 47 THEN 95 - c - dc ELSE c + dc END AS cc
   FROM v_raster, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)) a JOIN v_raster b ON b.scene_id = a.scene_id AND b.r = a.rr AND b.c = a.cc GROUP BY ALL""",
    "v_bg": """SELECT scene_id, avg(own) AS bg_mean, var_samp(own) AS bg_var, count(own) AS bg_n, CASE WHEN count(own) >= 25 THEN 'ok' ELSE 'background too small' END AS status FROM v_box WHERE NOT inside GROUP BY 1""",
    "v_welch": """SELECT *, CASE WHEN t >= 0 THEN tail ELSE 1 - tail END AS p FROM (SELECT *, CASE WHEN df IS NOT NULL THEN
  list_sum(list_transform(range(0, 1025), lambda k: (CASE WHEN k IN (0, 1024) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos(th + (pi() / 2 - th) * k / 1024.0), 0) ** (df - 1))) * (pi() / 2 - th) /
  (list_sum(list_transform(range(0, 1025), lambda k: (CASE WHEN k IN (0, 1024) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos(pi() / 2 * k / 1024.0), 0) ** (df - 1))) * (pi() / 2) * 2) END AS tail
  FROM (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM (SELECT v_nbr.*, (mean_local - bg_mean) / sqrt(var_local / n_local + bg_var / bg_n) AS t,
  (var_local / n_local + bg_var / bg_n) ** 2 / ((var_local / n_local) ** 2 / greatest(n_local - 1, 1) + (bg_var / bg_n) ** 2 / (bg_n - 1)) AS df FROM v_nbr JOIN v_bg USING (scene_id))))""",
    "v_cand": """SELECT scene_id, r, c, own, coalesce(p < 0.05 AND n_local >= 12.5 AND own IS NOT NULL, false) AS candidate FROM v_welch""",
    "v_major": """SELECT a.scene_id, a.r, a.c, count(*) FILTER (b.candidate) >= 5 AS majority FROM (SELECT scene_id, r, c, least(greatest(r + dr, 0), 47) AS rr, least(greatest(c + dc, 0), 47) AS cc
  FROM v_cand, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-1, 2)) AS dc)) a JOIN v_cand b ON b.scene_id = a.scene_id AND b.r = a.rr AND b.c = a.cc GROUP BY ALL""",
    "v_smooth": """SELECT scene_id, r, c, sum(m * w) AS smoothed FROM (SELECT a.scene_id, a.r, a.c, b.majority::INTEGER AS m, exp(-(dr * dr + dc * dc) / 8.0::DOUBLE) / (SELECT sum(exp(-k * k / 8.0::DOUBLE)) FROM (SELECT unnest(range(-8, 9)) AS k)) ** 2 AS w
  FROM (SELECT scene_id, r, c, dr, dc, CASE WHEN r + dr < 0 THEN -1 - r - dr WHEN r + dr > 47 THEN 95 - r - dr ELSE r + dr END AS rr, CASE WHEN c + dc < 0 THEN -1 - c - dc WHEN c + dc > 47 THEN 95 - c - dc ELSE c + dc END AS cc
   FROM v_major, (SELECT unnest(range(-8, 9)) AS dr), (SELECT unnest(range(-8, 9)) AS dc)) a JOIN v_major b ON b.scene_id = a.scene_id AND b.r = a.rr AND b.c = a.cc) GROUP BY ALL""",
    "v_plume": "SELECT scene_id, r, c FROM v_smooth WHERE smoothed > 0.5",
    "v_labadj": "SELECT p.scene_id, p.r * 48 + p.c AS x, q.r * 48 + q.c AS y FROM v_mask p JOIN v_mask q ON p.scene_id = q.scene_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1",
    "v_labreach": "SELECT scene_id, x AS a, x AS b FROM v_labadj UNION SELECT s.scene_id, s.a, j.y FROM v_labreach s JOIN v_labadj j ON j.scene_id = s.scene_id AND j.x = s.b",
    "v_lab": "SELECT scene_id, b // 48 AS r, b % 48 AS c, dense_rank() OVER (PARTITION BY scene_id ORDER BY root) AS label FROM (SELECT scene_id, b, min(a) AS root FROM v_labreach GROUP BY ALL)",
    "v_labfouradj": "SELECT p.scene_id, p.r * 48 + p.c AS x, q.r * 48 + q.c AS y FROM v_mask p JOIN v_mask q ON p.scene_id = q.scene_id AND abs(p.r - q.r) + abs(p.c - q.c) <= 1",
    "v_labfourreach": "SELECT scene_id, x AS a, x AS b FROM v_labfouradj UNION SELECT s.scene_id, s.a, j.y FROM v_labfourreach s JOIN v_labfouradj j ON j.scene_id = s.scene_id AND j.x = s.b",
    "v_labfour": "SELECT scene_id, b // 48 AS r, b % 48 AS c, dense_rank() OVER (PARTITION BY scene_id ORDER BY root) AS label FROM (SELECT scene_id, b, min(a) AS root FROM v_labfourreach GROUP BY ALL)",
    "v_segadj": "SELECT p.scene_id, p.r * 48 + p.c AS x, q.r * 48 + q.c AS y FROM v_plume p JOIN v_plume q ON p.scene_id = q.scene_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1",
    "v_segreach": "SELECT scene_id, x AS a, x AS b FROM v_segadj UNION SELECT s.scene_id, s.a, j.y FROM v_segreach s JOIN v_segadj j ON j.scene_id = s.scene_id AND j.x = s.b",
    "v_seg": "SELECT scene_id, b // 48 AS r, b % 48 AS c, dense_rank() OVER (PARTITION BY scene_id ORDER BY root) AS label FROM (SELECT scene_id, b, min(a) AS root FROM v_segreach GROUP BY ALL)",
    "v_glt": f"""SELECT scene_id, oy, ox, (ox * 5 + oy) % 51 AS glt_x, (oy * 7 + ox) % 50 AS glt_y
  FROM v_extent, (SELECT unnest(range({SIDE})) AS oy), (SELECT unnest(range({SIDE})) AS ox)""",
    "v_mask": "SELECT scene_id, r, c, own, ref, lon, lat FROM v_raster WHERE own > 60.0",
    "v_bands": """SELECT scene_id, band, 2000.0::DOUBLE + 12.5::DOUBLE * band AS wl, 8.5::DOUBLE AS fwhm, -(1.0::DOUBLE + (band * 7) % 5) / 1000.0::DOUBLE AS k
  FROM (SELECT DISTINCT vec_id // 500 AS scene_id FROM embeddings), (SELECT unnest(range(64)) AS band)""",
    "v_pixels": """SELECT vec_id // 500 AS scene_id, vec_id AS line, label::BIGINT % 4 AS xtrack, list_transform(embedding, lambda x: 2.0::DOUBLE + x::DOUBLE) AS rad,
  [0, 0, 0, 0, CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END, 0, (vec_id % 3)::INTEGER] AS flags, vec_id % 13 = 0 AS bad FROM embeddings""",
    "v_hires": """SELECT p_partkey // 2000 AS scene_id, 2100.0::DOUBLE + (p_partkey % 2000) * 0.2::DOUBLE + ((p_partkey * 7) % 3) * 0.01::DOUBLE AS nm, p_size * 1e-22::DOUBLE AS kx FROM part""",
    "v_hbands": """SELECT scene_id, band, 2100.0::DOUBLE + 10.0::DOUBLE * band AS wl, 8.0::DOUBLE + band % 3 AS fwhm
  FROM (SELECT DISTINCT p_partkey // 2000 AS scene_id FROM part), (SELECT unnest(range(16)) AS band)""",
    "v_weather": """SELECT station % 20 AS cell_i, station // 20 AS cell_j, 10.0::DOUBLE + 0.25::DOUBLE * (station % 20) AS glat,
  350.0::DOUBLE + 0.25::DOUBLE * (station // 20) AS glon, epoch(hour_ts)::BIGINT AS ts,
  s::DOUBLE / n / 1000.0::DOUBLE AS u, w::DOUBLE / n AS v, 95000.0::DOUBLE + 100.0::DOUBLE * n AS sp, 280.0::DOUBLE + s::DOUBLE / n / 10000.0::DOUBLE AS t2m
  FROM (SELECT user_id // 15 AS station, date_trunc('hour', ts) AS hour_ts, sum(round(value * 100)::BIGINT) AS s, sum(event_id % 21 - 10) AS w, count(*) AS n
        FROM events GROUP BY ALL)""",
    "v_overpass": """SELECT event_id AS request_id, 10.0::DOUBLE + 0.25::DOUBLE * ((user_id // 15) % 20) + (event_id % 7 - 3) * 0.03::DOUBLE AS lat,
  -10.0::DOUBLE + 0.25::DOUBLE * ((user_id // 15) // 20) + (event_id % 5 - 2) * 0.04::DOUBLE AS lon, epoch(date_trunc('second', ts))::BIGINT AS t
  FROM events""",
    "v_points": """SELECT c_mktsegment AS layer, c_custkey AS feature_id, -20.0::DOUBLE + (c_custkey * 37 % 3600) / 90.0::DOUBLE AS lon,
  20.0::DOUBLE + (c_custkey * 53 % 1200) / 40.0::DOUBLE AS lat, 'LEASE ' || (c_custkey % 40)::VARCHAR || ' #' || c_custkey::VARCHAR AS name, c_acctbal AS bal FROM customer
  UNION ALL SELECT 'FACILITY', s_suppkey + 1000000000, -20.0::DOUBLE + ((s_suppkey * 11 + 3) * 37 % 3600) / 90.0::DOUBLE,
  20.0::DOUBLE + ((s_suppkey * 11 + 3) * 53 % 1200) / 40.0::DOUBLE, s_name, s_acctbal FROM supplier""",
    "v_wedges": """SELECT s_suppkey AS event_id, -20.0::DOUBLE + (s_suppkey * 71 % 360) / 9.0::DOUBLE AS apex_lon, 20.0::DOUBLE + (s_suppkey * 29 % 120) / 4.0::DOUBLE AS apex_lat,
  (s_suppkey % 9 - 4) * 1.0::DOUBLE + 0.5::DOUBLE AS u, (s_suppkey % 7 - 3) * 1.0::DOUBLE + 0.25::DOUBLE AS v, 0.5::DOUBLE + (s_suppkey % 5) * 0.5::DOUBLE AS sigma,
  2.5::DOUBLE AS u_eff, 1000.0::DOUBLE + 10.0::DOUBLE * (s_suppkey % 50) AS length_m FROM supplier""",
    "v_polys": """SELECT poly_id, x, y, [[{'lon': x - 2.0, 'lat': y - 1.0}, {'lon': x + 2.0, 'lat': y - 1.0}, {'lon': x + 2.0, 'lat': y + 1.0}, {'lon': x + 0.25, 'lat': y - 0.25},
  {'lon': x - 2.0, 'lat': y + 1.0}, {'lon': x - 2.0, 'lat': y - 1.0}]] AS rings
  FROM (SELECT s_suppkey AS poly_id, -20.0::DOUBLE + (s_suppkey * 71 % 360) / 9.0::DOUBLE AS x, 20.0::DOUBLE + (s_suppkey * 29 % 120) / 4.0::DOUBLE AS y FROM supplier)""",
    "v_events": """SELECT n_nationkey::BIGINT AS event_id, n_name AS name, CASE WHEN n_nationkey % 4 = 3 THEN 'heat_wave' WHEN n_nationkey % 4 = 2 THEN 'flood' ELSE 'emission' END AS phenomenon,
  n_nationkey % 4 = 3 AS is_area, CASE WHEN n_nationkey % 3 = 0 THEN ['1-URGENT', '2-HIGH'] ELSE ['1-URGENT', '3-MEDIUM', '5-LOW'] END AS expected_types,
  TIMESTAMP '1995-06-01 00:00:00' + to_days(n_nationkey * 40) AS e_t0,
  CASE WHEN n_nationkey % 5 <> 4 THEN TIMESTAMP '1995-06-01 00:00:00' + to_days(n_nationkey * 40 + 900) END AS e_t1,
  10.0::DOUBLE + n_nationkey AS e_lon, 20.0::DOUBLE + n_nationkey * 0.5::DOUBLE AS e_lat, CASE WHEN n_nationkey % 2 = 0 THEN 10.0::DOUBLE + n_nationkey END AS precision_km,
  9.5::DOUBLE + n_nationkey AS b0, 19.75::DOUBLE + n_nationkey * 0.5::DOUBLE AS b1, 10.5::DOUBLE + n_nationkey AS b2, 20.25::DOUBLE + n_nationkey * 0.5::DOUBLE AS b3,
  CASE WHEN n_nationkey % 3 <> 1 THEN 'ACQ' || n_nationkey END AS acquisition, n_nationkey % 6 <> 5 AS has_recipe FROM nation""",
    "v_dets": """SELECT o_orderkey AS det_id, o_custkey % 25 AS event_id, o_orderpriority AS type, 10.0::DOUBLE + o_custkey % 25 + (o_orderkey % 17 - 8) * 0.01::DOUBLE AS lon,
  20.0::DOUBLE + (o_custkey % 25) * 0.5::DOUBLE + (o_orderkey % 13 - 6) * 0.01::DOUBLE AS lat, o_orderdate AS t0, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS t1,
  o_orderkey % 4 <> 0 AS has_fp, 9.5::DOUBLE + o_custkey % 25 + (o_orderkey % 11) * 0.1::DOUBLE AS f0, 19.75::DOUBLE + (o_custkey % 25) * 0.5::DOUBLE + (o_orderkey % 7) * 0.05::DOUBLE AS f1,
  10.2::DOUBLE + o_custkey % 25 + (o_orderkey % 11) * 0.1::DOUBLE AS f2, 20.15::DOUBLE + (o_custkey % 25) * 0.5::DOUBLE + (o_orderkey % 7) * 0.05::DOUBLE AS f3,
  o_totalprice / 1000.0::DOUBLE AS m_rate, (o_orderkey % 50)::DOUBLE AS m_mass FROM orders""",
    "v_refs": """SELECT n_nationkey::BIGINT AS event_id, 'rate' AS name, 100.0::DOUBLE + n_nationkey AS value, CASE WHEN n_nationkey % 3 = 0 THEN 'scope_mismatch' ELSE 'comparable' END AS usability,
  CASE WHEN n_nationkey % 3 = 0 THEN 'cluster total ' || n_nationkey END AS why FROM nation
  UNION ALL SELECT n_nationkey, 'mass', CASE WHEN n_nationkey % 7 = 0 THEN 0.0 ELSE 20.0 END, 'comparable', NULL FROM nation""",
    "v_runs": """SELECT n_nationkey::BIGINT AS event_id, CASE WHEN n_nationkey % 8 = 7 THEN 'not_runnable' WHEN n_nationkey % 11 = 10 THEN 'error' ELSE 'ran' END AS status,
  n_nationkey * 0.5::DOUBLE + 1.0::DOUBLE AS latency_s FROM nation""",
    "v_items": """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 4 THEN 'MYD11A1' ELSE 'MOD11A1' END) || '.A' || strftime(o_orderdate, '%Y') || lpad(dayofyear(o_orderdate)::VARCHAR, 3, '0')
  || '.h' || lpad((o_custkey // 100)::VARCHAR, 2, '0') || 'v0' || (o_custkey % 3)::VARCHAR || '.061.' || lpad(o_orderkey::VARCHAR, 9, '0') AS item_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'LST_Day_1km' WHEN 1 THEN 'QC_Day' ELSE 'Day_view_time' END AS asset, o_orderdate::DATE AS day FROM orders""",
    "v_lst": """SELECT l_suppkey // 25 AS tile, l_shipdate::DATE AS day, l_partkey % 6 AS row, l_suppkey % 6 AS col,
  CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE trunc(14000 + l_extendedprice / 50)::BIGINT END AS raw, l_orderkey % 8 AS qc, l_linenumber % 2 = 1 AS daily,
  CASE WHEN l_orderkey % 19 = 0 THEN 255 ELSE 95 + l_orderkey % 20 END AS view_time FROM lineitem""",
    "v_scores": """SELECT p_partkey // 60 AS event_id, (p_partkey // 3) % 20 AS cand, ['spatial', 'type', 'magnitude'][p_partkey % 3 + 1] AS component,
  p_size / 50.0::DOUBLE AS value, [0.60::DOUBLE, 0.25, 0.15][p_partkey % 3 + 1] AS weight FROM part""",
}


def twin(views: str, body: str) -> str:
    """A self-contained query: the named views (with what they need) before ``body``.

    ``body`` starts with SELECT, or with further ``name AS (...)`` definitions.
    """
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in re.findall(r"\bv_[a-z]+\b", SQL[name]):
            if other != name and other in SQL:
                add(other)
        order.append(name)

    for v in views.split():
        add(v)
    parts = [f"{v} AS ({SQL[v]})" for v in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
    if body.upper().startswith("SELECT"):
        return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
    return f"WITH RECURSIVE {', '.join([*parts, ''])}{body}"
