"""Weather look-ups, wedges, polygons, candidates and source hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as K
from ..functions import geo
from ..functions.numeric import geodesic
from ..operators import asof, attribution, raster, spatial
from ..operators.percentiles import latest_per_key
from ..session import materialise
from ..sources import features
from . import fixtures as X
from .registry import query, rnd, rnd_scaled

#: Radius of the first hundred wedges; later ones are smaller, so that the pairs grow like the tables.
RADIUS_KM = 250.0


def vincenty(source: str, keys: str, rounds: int = 10) -> str:
    """SQL text: ``source`` (with lon1, lat1, lon2, lat2) plus dist_m and azimuth."""
    f, a = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    q = (f"SELECT {keys}, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2) - radians(lon1) AS bl, "
         f"radians(lon2) - radians(lon1) AS lam FROM {source}")
    names = keys
    ang = (
        "sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, "
        "atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa, 1 - sa * sa AS ca2, CASE WHEN ca2 = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / ca2 END AS cm"
    )
    for _ in range(rounds):
        q = (f"SELECT {names}, u1, u2, bl, bl + (1 - cc) * {f} * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM "
             f"(SELECT {names}, u1, u2, bl, lam, {ang}, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS cc FROM ({q}))")
    b = f"({a} * (1 - {f}))"
    return (
        f"SELECT {names}, {b} * biga * (sig - bigb * ss * (cm + bigb / 4 * (cs * (2 * cm * cm - 1) - bigb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS dist_m, "
        "(degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) + 360) % 360 AS azimuth "
        f"FROM (SELECT {names}, u1, u2, lam, {ang}, ca2 * ({a} ** 2 - {b} ** 2) / {b} ** 2 AS usq, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS biga, "
        f"usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bigb FROM ({q}))"
    )


_WEDGE = f"""
wg AS (SELECT *, sqrt(u * u + v * v) AS speed, (degrees(atan2(u, v)) + 360) % 360 AS down, (degrees(atan2(u, v)) + 540) % 360 AS up, degrees(atan2(sigma, sqrt(u * u + v * v))) AS h1,
 degrees(atan2(2 * sigma, sqrt(u * u + v * v))) AS h2 FROM v_wedges),
pr AS (SELECT event_id, feature_id, layer, name, bal, up, h1, h2, {RADIUS_KM}::DOUBLE / (1 + event_id // 100) AS rad, apex_lon AS lon1, apex_lat AS lat1, p.lon AS lon2, p.lat AS lat2 FROM wg, v_points p),
gd AS ({vincenty('pr', 'event_id, feature_id, layer, name, bal, up, h1, h2, rad')}),
rel AS (SELECT event_id, feature_id, layer, name, bal, dist_m / 1000 AS dist_km, azimuth, least(abs(azimuth - up), 360 - abs(azimuth - up)) AS dev, h1, h2 FROM gd WHERE dist_m / 1000 <= rad)
"""


def _wedges(spark, sf):
    w = X.v_wedges(spark, sf)
    g = geo.wedge(F.col("u"), F.col("v"), F.hypot("u", "v"), F.col("sigma"), F.col("u_eff"), F.col("length_m"))
    return w.select("*", g.alias("g")).select("event_id", "apex_lon", "apex_lat", "u", "v", "g.*", (F.lit(RADIUS_KM) / (1 + F.floor(F.col("event_id") / 100))).alias("radius_km"))


def _related(spark, sf, layer="true", only_2s=False):
    return spatial.relate_to_wedges(X.v_points(spark, sf).where(layer), _wedges(spark, sf), 2.0, only_2s)


def _wells(spark, sf):
    """Ranked candidates; the joined pairs are written once because ranking reads them several times."""
    pairs = materialise(_related(spark, sf, "layer <> 'FACILITY'", only_2s=True), "wedge-pairs")
    return materialise(spatial.rank_candidates(pairs.withColumn("operator", F.col("layer"))), "ranked")


@query("f11_wedge", "v_wedges", """
SELECT event_id, round((degrees(atan2(u, v)) + 360) % 360, 6) AS downwind_deg, round((degrees(atan2(u, v)) + 540) % 360, 6) AS upwind_deg, round(degrees(atan2(sigma, sqrt(u * u + v * v))), 6) AS half1_deg,
round(degrees(atan2(2 * sigma, sqrt(u * u + v * v))), 6) AS half2_deg, round(length_m / u_eff, 6) AS transit_s FROM v_wedges""")
def f11(spark, sf):
    return _wedges(spark, sf).select("event_id", *[rnd(c).alias(c) for c in ("downwind_deg", "upwind_deg", "half1_deg", "half2_deg", "transit_s")])


@query("j11_wedge_join", "v_wedges v_points", _WEDGE + """
SELECT event_id, feature_id, layer, round(dist_km, 6) AS dist_km, round(dev, 6) AS dev_deg, dev <= h1 AS in_1s, dev <= h2 AS in_2s FROM rel""")
def j11(spark, sf):
    return _related(spark, sf).select("event_id", "feature_id", "layer", rnd("dist_km").alias("dist_km"), rnd("dev_deg").alias("dev_deg"), "in_1s", "in_2s")


@query("j12_geodesic", "v_points", f"""
pr AS (SELECT feature_id, lon AS lon1, lat AS lat1, -5.0::DOUBLE + (feature_id % 31) AS lon2, 30.0::DOUBLE + (feature_id % 17) * 0.5::DOUBLE AS lat2 FROM v_points), gd AS ({vincenty('pr', 'feature_id')})
SELECT feature_id, round(dist_m, 3) AS dist_m, round(azimuth, 6) AS azimuth_deg FROM gd""")
def j12(spark, sf):
    p = X.v_points(spark, sf).withColumn("lon2", F.expr("-5.0D + (feature_id % 31)")).withColumn("lat2", F.expr("30.0D + (feature_id % 17) * 0.5D"))
    return p.select("feature_id", geodesic("lon", "lat", "lon2", "lat2").alias("g")).select(
        "feature_id", rnd("g.dist_m", 3).alias("dist_m"), rnd("g.azimuth_deg").alias("azimuth_deg"))


_PIP = """
ed AS (SELECT poly_id, unnest([{'a': x - 2.0, 'b': y - 1.0, 'c': x + 2.0, 'd': y - 1.0}, {'a': x + 2.0, 'b': y - 1.0, 'c': x + 2.0, 'd': y + 1.0}, {'a': x + 2.0, 'b': y + 1.0, 'c': x + 0.25, 'd': y - 0.25},
 {'a': x + 0.25, 'b': y - 0.25, 'c': x - 2.0, 'd': y + 1.0}, {'a': x - 2.0, 'b': y + 1.0, 'c': x - 2.0, 'd': y - 1.0}]) AS e FROM v_polys)
"""


@query("j13_point_in_polygon", "v_points v_polys", _PIP + """
SELECT feature_id AS point_id, poly_id FROM v_points, ed WHERE (e.b > lat) <> (e.d > lat) AND lon < (e.c - e.a) * (lat - e.b) / (e.d - e.b) + e.a GROUP BY ALL HAVING count(*) % 2 = 1""")
def j13(spark, sf):
    pts = X.v_points(spark, sf).select(F.col("feature_id").alias("point_id"), "lon", "lat")
    return spatial.points_in_polygons(pts, X.v_polys(spark, sf))


@query("j14_interior_point", "v_polys", _PIP + """,
cr AS (SELECT poly_id, y, (e.c - e.a) * (y - e.b) / (e.d - e.b) + e.a AS x FROM ed JOIN (SELECT poly_id, y FROM v_polys) USING (poly_id) WHERE (e.b > y) <> (e.d > y)),
sp AS (SELECT *, row_number() OVER q AS i, lead(x) OVER q AS nx FROM cr WINDOW q AS (PARTITION BY poly_id ORDER BY x))
SELECT poly_id, round(p.m, 6) AS lon, round(any_value(y), 6) AS lat FROM (SELECT poly_id, y, arg_min({'m': (x + nx) / 2}, {'a': -(nx - x), 'b': x}) OVER (PARTITION BY poly_id) AS p FROM sp WHERE i % 2 = 1) GROUP BY ALL""".replace(
    "SELECT poly_id, round(p.m, 6) AS lon, round(any_value(y), 6) AS lat FROM (SELECT poly_id, y, arg_min({'m': (x + nx) / 2}, {'a': -(nx - x), 'b': x}) OVER (PARTITION BY poly_id) AS p FROM sp WHERE i % 2 = 1) GROUP BY ALL",
    "SELECT poly_id, round(arg_min((x + nx) / 2, {'a': -round(nx - x, 9), 'b': x}), 6) AS lon, round(any_value(y), 6) AS lat FROM sp WHERE i % 2 = 1 GROUP BY poly_id"))
def j14(spark, sf):
    return spatial.representative_points(X.v_polys(spark, sf)).select("poly_id", rnd("lon").alias("lon"), rnd("lat").alias("lat"))


@query("t1_ranked_candidates", "v_wedges v_points", _WEDGE + """
SELECT event_id, feature_id, row_number() OVER (PARTITION BY event_id ORDER BY dev, dist_km, feature_id) AS rank, count(*) OVER (PARTITION BY event_id) AS n_2s, count(*) FILTER (dev <= h1) OVER (PARTITION BY event_id) AS n_1s
FROM rel WHERE dev <= h2 AND layer <> 'FACILITY'""")
def t1(spark, sf):
    return _wells(spark, sf).select("event_id", "feature_id", "rank", "n_2s", "n_1s")


@query("t2_nearest_candidate", "v_wedges v_points", _WEDGE + """
SELECT event_id, arg_min(feature_id, {'a': dist_km, 'b': feature_id}) AS near_id, round(min(dist_km), 6) AS near_km FROM rel WHERE dev <= h2 AND layer <> 'FACILITY' GROUP BY 1""")
def t2(spark, sf):
    s = attribution.facility_summary(_wells(spark, sf))
    return s.select("event_id", "near_id", rnd("near_km").alias("near_km"))


@query("t3_flare_months", "v_wedges v_points", _WEDGE + """,
fl AS (SELECT *, DATE '2023-01-10' + ((feature_id * 17) % 900)::INTEGER AS d FROM rel WHERE dev <= h2 AND layer = 'FACILITY'),
p AS (SELECT event_id, arg_min({'i': feature_id, 'd': d}, {'a': dist_km, 'b': feature_id}) AS n, arg_min({'i': feature_id, 'd': d}, feature_id) AS f FROM fl GROUP BY 1)
SELECT event_id, n.i AS nearest_id, (year(n.d) - 2022) * 12 + month(n.d) - 8 AS nearest_months, f.i AS first_id, (year(f.d) - 2022) * 12 + month(f.d) - 8 AS first_months FROM p""")
def t3(spark, sf):
    fl = _related(spark, sf, "layer = 'FACILITY'").where("in_2s").select(
        "event_id", "feature_id", "dist_km", F.expr("date_add(date'2023-01-10', cast((feature_id * 17) % 900 as int))").alias("d"))
    near = latest_per_key(fl, ["event_id"], F.struct("dist_km", "feature_id"), first=True)
    first = latest_per_key(fl, ["event_id"], F.col("feature_id"), first=True)
    acq = F.lit("2022-08-15").cast("date")
    pick = lambda d, p: d.select("event_id", F.col("feature_id").alias(f"{p}_id"), K.months_between_calendar(acq, F.col("d")).alias(f"{p}_months"))
    return pick(near, "nearest").join(pick(first, "first"), "event_id")


_FAC = _WEDGE + """,
c AS (SELECT *, trim(split_part(name, ' #', 1)) AS lease, row_number() OVER (PARTITION BY event_id ORDER BY dev, dist_km, feature_id) AS rank, count(*) OVER (PARTITION BY event_id) AS n2, count(*) FILTER (dev <= h1) OVER (PARTITION BY event_id) AS n1
 FROM rel WHERE dev <= h2 AND layer <> 'FACILITY'),
top AS (SELECT event_id, feature_id AS top_id, lease AS top_lease, layer AS top_operator, n2, n1 FROM c WHERE rank = 1),
fac AS (SELECT event_id, top_id, top_lease, top_operator, top.n2 AS n_2s, top.n1 AS n_1s, count(*) AS n_pad FROM top JOIN c USING (event_id) WHERE lease = top_lease AND layer = top_operator GROUP BY ALL)
"""


@query("a45_pad_groups", "v_wedges v_points", _FAC + "SELECT * FROM fac")
def a45(spark, sf):
    return attribution.facility_summary(_wells(spark, sf)).select("event_id", "top_id", "top_lease", "top_operator", "n_2s", "n_1s", "n_pad")


@query("t4_alternatives", "v_wedges v_points", _FAC + """,
o AS (SELECT c.event_id, feature_id, row_number() OVER (PARTITION BY c.event_id ORDER BY rank) AS alt, count(*) OVER (PARTITION BY c.event_id) AS n_other FROM c JOIN fac USING (event_id) WHERE NOT (lease = top_lease AND layer = top_operator))
SELECT event_id, n_other, alt, feature_id FROM o WHERE alt <= 8""")
def t4(spark, sf):
    r = _wells(spark, sf)
    return attribution.alternatives(r, attribution.facility_summary(r))


_SCORED = """round_even(0.6::DOUBLE * s + 0.25::DOUBLE * t + 0.15::DOUBLE * m, 4)"""


@query("h2_facility_hypotheses", "v_wedges v_points", _FAC + f""",
h AS (SELECT fac.event_id, hyp, rank, {_SCORED} AS score FROM fac, (VALUES ('H1', 1, 0.5::DOUBLE, 0.85::DOUBLE, 0.8::DOUBLE), ('H2', 2, 0.3, 0.85, 0.8), ('H3', 3, 0.5, 0.08, 0.3)) v(hyp, rank, s, t, m))
SELECT event_id, hyp, rank, score, CASE WHEN score >= 0.30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS tier, score >= 0.55 AS capped FROM h""")
def h2(spark, sf):
    h = attribution.facility_hypotheses(attribution.facility_summary(_wells(spark, sf)))
    return h.select("event_id", "hyp", "rank", "score", "tier", "capped")


@query("h1_field_hypotheses", "v_wedges v_polys", _PIP + f""",
ct AS (SELECT event_id, count(*) FILTER (odd) > 0 AS contained FROM (SELECT event_id, poly_id, count(*) FILTER ((e.b > apex_lat - 0.4) <> (e.d > apex_lat - 0.4) AND apex_lon - 3.7 < (e.c - e.a) * (apex_lat - 0.4 - e.b) / (e.d - e.b) + e.a) % 2 = 1 AS odd FROM v_wedges, ed GROUP BY ALL) GROUP BY 1),
h AS (SELECT event_id, hyp, rank, round_even(0.6::DOUBLE * CASE WHEN hyp = 'H1' AND NOT contained THEN 0.5 ELSE s END + 0.25::DOUBLE * t + 0.15::DOUBLE * m, 4) AS score FROM ct, (VALUES ('H1', 1, 0.85::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE), ('H2', 2, 0.3, 0.9, 0.9), ('H3', 3, 0.5, 0.15, 0.4)) v(hyp, rank, s, t, m))
SELECT event_id, hyp, rank, score, CASE WHEN score >= 0.55 THEN 'MODERATE' WHEN score >= 0.30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS tier, score >= 0.80 AS capped FROM h""")
def h1(spark, sf):
    w = X.v_wedges(spark, sf).select("event_id", (F.col("apex_lon") - 3.7).alias("lon"), (F.col("apex_lat") - 0.4).alias("lat"))
    hit = spatial.points_in_polygons(w.withColumnRenamed("event_id", "point_id"), X.v_polys(spark, sf)).select(F.col("point_id").alias("event_id")).distinct()
    s = w.join(hit.withColumn("_h", F.lit(True)), "event_id", "left").withColumn("contained", F.coalesce("_h", F.lit(False)))
    return attribution.field_hypotheses(s).select("event_id", "hyp", "rank", "score", "tier", "capped")


@query("h3_bearing_gap", "v_wedges", f"""
pr AS (SELECT event_id, apex_lon + u * 0.01::DOUBLE AS lon1, apex_lat + v * 0.015::DOUBLE AS lat1, apex_lon AS lon2, apex_lat AS lat2, (degrees(atan2(u, v)) + 540) % 360 AS up FROM v_wedges), gd AS ({vincenty('pr', 'event_id, up')})
SELECT event_id, round(azimuth, 6) AS bearing_deg, round(least(abs(azimuth - up), 360 - abs(azimuth - up)), 6) AS gap_deg FROM gd""")
def h3(spark, sf):
    w = _wedges(spark, sf).withColumn("g", geodesic(F.col("apex_lon") + F.col("u") * 0.01, F.col("apex_lat") + F.col("v") * 0.015, F.col("apex_lon"), F.col("apex_lat")))
    return w.select("event_id", rnd("g.azimuth_deg").alias("bearing_deg"), rnd(geo.angular_diff(F.col("g.azimuth_deg"), F.col("upwind_deg"))).alias("gap_deg"))


@query("s5_feature_box_scan", "v_points", """
SELECT layer, count(*) AS n, round(sum(lon), 4) AS sum_lon FROM v_points WHERE feature_id % 41 <> 0 AND feature_id % 13 <> 5 AND lon + 0.05 >= -5 AND lon - 0.05 <= 12 AND lat + 0.05 >= 25 AND lat - 0.05 <= 40 GROUP BY 1""")
def s5(spark, sf):
    p = X.v_points(spark, sf)
    gone = F.expr("feature_id % 41 = 0")
    f = p.select("layer", "feature_id", "lon", "lat", F.expr("case when feature_id % 13 = 5 then 3857 else 4326 end").alias("srs"),
                 F.when(~gone, F.col("lon") - 0.05).alias("min_lon"), F.when(~gone, F.col("lon") + 0.05).alias("max_lon"),
                 F.when(~gone, F.col("lat") - 0.05).alias("min_lat"), F.when(~gone, F.col("lat") + 0.05).alias("max_lat"))
    return features.scan_box(f, (-5.0, 25.0, 12.0, 40.0)).groupBy("layer").agg(F.count("*").alias("n"), rnd(F.sum("lon"), 4).alias("sum_lon"))


# ------------------------------------------------------------------ weather


def _requests(spark, sf):
    o = X.v_overpass(spark, sf)
    lon = geo.normalise_lon(F.col("lon"), -10.0, 350.0)
    return o.withColumn("cell_i", raster.nearest_index(F.col("lat"), 10.0, 0.25)).withColumn("cell_j", raster.nearest_index(lon, 350.0, 0.25))


@query("j4_nearest_cell", "v_overpass", """
SELECT request_id, ceil((lat - 10.0) / 0.25 - 0.5)::BIGINT AS cell_i, ceil((lon + 360 - 350.0) / 0.25 - 0.5)::BIGINT AS cell_j FROM v_overpass""")
def j4(spark, sf):
    return _requests(spark, sf).select("request_id", "cell_i", "cell_j")


_BRACKET = """
rq AS (SELECT *, ceil((lat - 10.0) / 0.25 - 0.5)::BIGINT AS cell_i, ceil((lon + 360 - 350.0) / 0.25 - 0.5)::BIGINT AS cell_j FROM v_overpass),
sm AS (SELECT cell_i, cell_j, ts, {'ts': ts, 'u': u, 'v': v, 'sp': sp} AS s FROM v_weather),
nb AS (SELECT cell_i, cell_j, ts, s, lag(s) OVER k AS p, lead(s) OVER k AS n FROM sm WINDOW k AS (PARTITION BY cell_i, cell_j ORDER BY ts)),
be AS (SELECT rq.*, a.s AS a, a.p AS ap FROM rq ASOF LEFT JOIN nb a ON a.cell_i = rq.cell_i AND a.cell_j = rq.cell_j AND rq.t >= a.ts),
bo AS (SELECT be.*, b.s AS b, b.n AS bn FROM be ASOF LEFT JOIN nb b ON b.cell_i = be.cell_i AND b.cell_j = be.cell_j AND be.t <= b.ts),
ln AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a WHEN a IS NULL THEN b WHEN ap IS NOT NULL THEN ap ELSE a END AS x,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b WHEN a IS NULL THEN bn WHEN ap IS NOT NULL THEN a END AS y,
 CASE WHEN a IS NULL THEN b.ts WHEN b IS NULL THEN a.ts WHEN t - a.ts <= b.ts - t THEN a.ts ELSE b.ts END AS near FROM bo),
ip AS (SELECT request_id, t, near, x, y, coalesce(abs(near - t) <= 3600, false) AS ok, CASE WHEN y.ts > x.ts THEN (t - x.ts)::DOUBLE / (y.ts - x.ts) END AS fr FROM ln),
vl AS (SELECT request_id, ok, CASE WHEN ok THEN abs(near - t) / 3600.0::DOUBLE END AS d, CASE WHEN ok THEN coalesce(x.u + (y.u - x.u) * fr, x.u) END AS u, CASE WHEN ok THEN coalesce(x.v + (y.v - x.v) * fr, x.v) END AS v,
 CASE WHEN ok THEN coalesce(x.sp + (y.sp - x.sp) * fr, x.sp) END AS sp FROM ip)
"""


@query("j5_bracket_interpolation", "v_overpass v_weather", _BRACKET + """
SELECT request_id, round(u, 11) AS u, round(v, 11) AS v, round(sqrt(u * u + v * v), 11) AS speed, round(sp, 4) AS sp, round(d, 6) AS hour_distance, CASE WHEN ok THEN 'ok' ELSE 'no sample' END AS status FROM vl""")
def j5(spark, sf):
    out = asof.bracket_interpolate(_requests(spark, sf), X.v_weather(spark, sf), ["cell_i", "cell_j"], ["u", "v", "sp", "t2m"])
    return out.select(
        "request_id", rnd_scaled("u", 11).alias("u"), rnd_scaled("v", 11).alias("v"),
        rnd_scaled(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 11).alias("speed"), rnd_scaled("sp", 4).alias("sp"),
        rnd_scaled("hour_distance", 6).alias("hour_distance"), "status",
    )


@query("f8_wind_sample_sigma", "v_overpass v_weather", _BRACKET + """
SELECT request_id, round(CASE WHEN ok THEN least(3.0::DOUBLE, 1.6::DOUBLE + 0.4::DOUBLE * d) END, 6) AS u10_sigma FROM vl""")
def f8(spark, sf):
    from ..functions import physics as P

    out = asof.bracket_interpolate(_requests(spark, sf), X.v_weather(spark, sf), ["cell_i", "cell_j"], ["u", "v"])
    sigma = F.when(F.col("status") == "ok", P.u10_sample_sigma(F.col("hour_distance")))
    return out.select("request_id", rnd(sigma).alias("u10_sigma"))
