"""Formulae, tiers, factor diagnostics, hypotheses, data quality and event reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import physics as P
from ..functions import scoring as S
from ..operators import attribution, climate, plume, quality, reporting
from ..session import materialise
from . import fixtures as X
from .registry import query, rnd

# ------------------------------------------------------------------ formulae over the line items


def _li(spark, sf, *cols):
    return X.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols])


ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("f1_pixel_area", "", f"SELECT {_ID}, round(0.000542::DOUBLE * 0.000542::DOUBLE * 111319.49079327357::DOUBLE ** 2 * cos(radians(l_quantity)), 6) AS area_m2 FROM lineitem")
def f1(spark, sf):
    return _li(spark, sf, "l_quantity").select(*ID, rnd(P.pixel_area_m2(F.col("l_quantity"), 0.000542, 0.000542)).alias("area_m2"))


@query("f2_cell_area", "", f"SELECT {_ID}, round((6371.0088::DOUBLE * pi() / 180) ** 2 * 0.0625::DOUBLE * cos(radians(l_quantity)), 6) AS area_km2 FROM lineitem")
def f2(spark, sf):
    return _li(spark, sf, "l_quantity").select(*ID, rnd(P.cell_area_km2(F.col("l_quantity"), 0.25, 0.25)).alias("area_km2"))


@query("f3_air_density", "", f"SELECT {_ID}, CASE WHEN l_quantity > 5 THEN round(l_extendedprice / (8.314462618::DOUBLE * (l_quantity - 5)), 6) END AS n_air FROM lineitem")
def f3(spark, sf):
    return _li(spark, sf, "l_quantity", "l_extendedprice").select(*ID, rnd(P.n_air(F.col("l_extendedprice"), F.col("l_quantity") - 5)).alias("n_air"))


@query("f4_mass_column", "", f"SELECT {_ID}, l_extendedprice * 1e-6::DOUBLE * 40.5::DOUBLE * 0.01604::DOUBLE AS kg_m2 FROM lineitem")
def f4(spark, sf):
    return _li(spark, sf, "l_extendedprice").select(*ID, P.ppm_m_to_kg_m2(F.col("l_extendedprice"), F.lit(40.5)).alias("kg_m2"))


@query("f5_effective_wind", "", f"SELECT {_ID}, CASE WHEN l_quantity > 2 THEN round(ln(l_quantity - 2) + 0.6::DOUBLE, 9) END AS u_eff FROM lineitem")
def f5(spark, sf):
    u = F.when(F.col("l_quantity") > 2, F.col("l_quantity") - 2)
    return _li(spark, sf, "l_quantity").select(*ID, rnd(P.u_eff(u), 9).alias("u_eff"))


@query("f6_emission_rate", "", f"SELECT {_ID}, CASE WHEN l_discount > 0 THEN l_quantity * l_extendedprice / (l_discount * 1000) END AS q_kg_s, CASE WHEN l_discount > 0 THEN l_quantity * l_extendedprice / (l_discount * 1000) * 3.6::DOUBLE END AS q_t_h FROM lineitem")
def f6(spark, sf):
    q = P.q_kg_s(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount") * 1000)
    return _li(spark, sf, "l_quantity", "l_extendedprice", "l_discount").select(*ID, q.alias("q_kg_s"), (q * 3.6).alias("q_t_h"))


@query("f7_wind_sigma", "", f"""
w AS (SELECT {_ID}, l_quantity / 5 AS u, 1.6::DOUBLE + l_tax AS s FROM lineitem), x AS (SELECT *, ln(u) + 0.6::DOUBLE AS ue, abs(ln(u)) * 0.1::DOUBLE AS a, s / u AS b FROM w)
SELECT {_ID}, CASE WHEN ue > 0 THEN round(a / ue, 9) END AS alpha1_term, CASE WHEN ue > 0 THEN round(b / ue, 9) END AS u10_term, CASE WHEN ue > 0 THEN round(sqrt(a * a + b * b) / ue, 9) END AS total FROM x""".replace("w AS", "WITH w AS", 1))
def f7(spark, sf):
    s = _li(spark, sf, "l_quantity", "l_tax").select(*ID, P.wind_sigma(F.col("l_quantity") / 5, 1.6 + F.col("l_tax")).alias("w"))
    return s.select(*ID, *[rnd(f"w.{c}", 9).alias(c) for c in ("alpha1_term", "u10_term", "total")])


@query("f10_angles", "", f"""
SELECT {_ID}, round(((l_extendedprice / 100 - 400) % 360 + 360) % 360, 6) AS norm, round(least(abs(((l_extendedprice / 100 - 400) % 360 + 360) % 360 - (l_quantity * 7) % 360), 360 - abs(((l_extendedprice / 100 - 400) % 360 + 360) % 360 - (l_quantity * 7) % 360)), 6) AS diff FROM lineitem""")
def f10(spark, sf):
    a = F.col("l_extendedprice") / 100 - 400
    return _li(spark, sf, "l_quantity", "l_extendedprice").select(*ID, rnd(geo.norm360(a)).alias("norm"), rnd(geo.angular_diff(a, F.col("l_quantity") * 7)).alias("diff"))


@query("f12_columns", "", f"""
SELECT {_ID}, round(l_extendedprice / (9.80665::DOUBLE * (0.0289644::DOUBLE / 6.02214076e23::DOUBLE)) * 1e-4::DOUBLE / 1e24, 6) AS dry_air, round(1e-6::DOUBLE * (l_extendedprice / (1.380649e-23::DOUBLE * (250 + l_quantity))) * 1e-4::DOUBLE / 1e15, 6) AS excess,
round(l_extendedprice / (1.380649e-23::DOUBLE * (250 + l_quantity)) * 1e-6::DOUBLE / 1e19, 6) AS density FROM lineitem""")
def f12(spark, sf):
    p, t = F.col("l_extendedprice"), 250 + F.col("l_quantity")
    return _li(spark, sf, "l_quantity", "l_extendedprice").select(
        *ID, rnd(P.dry_air_column(p) / 1e24).alias("dry_air"), rnd(P.excess_column_per_ppm_m(p, t) / 1e15).alias("excess"), rnd(P.air_number_density_cm3(p, t) / 1e19).alias("density"))


@query("f14_rarity", "", f"SELECT {_ID}, round(greatest(0, 2 * (l_quantity / 50 - 0.5)), 6) AS upper, round(greatest(0, 2 * (l_quantity / 50 - 0.5), 2 * (1 - l_quantity / 50 - 0.5)), 6) AS both_sides FROM lineitem")
def f14(spark, sf):
    p = F.col("l_quantity") / 50
    return _li(spark, sf, "l_quantity").select(*ID, rnd(S.rarity_above_median(p)).alias("upper"), rnd(S.rarity_two_sided(p)).alias("both_sides"))


@query("f15_tiers", "", """
SELECT p_partkey, CASE WHEN s >= 0.80 THEN 'HIGH' WHEN s >= 0.55 THEN 'MODERATE' WHEN s >= 0.30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS source_band, CASE WHEN s >= 0.55 THEN 'MODERATE' WHEN s >= 0.30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS capped_tier, s >= 0.80 AS capped,
CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.5 THEN 'MODERATE' WHEN s >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END AS factor_band FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS s FROM part)""")
def f15(spark, sf):
    p = X.table(spark, sf, "part", ["p_partkey", "p_size"]).withColumn("s", F.col("p_size") / 50.0)
    s = F.col("s")
    return p.select("p_partkey", S.band(s, S.SOURCE_EDGES).alias("source_band"), S.capped_band(s, S.SOURCE_EDGES, "MODERATE").alias("c"), S.band(s, S.FACTOR_EDGES).alias("factor_band")).select(
        "p_partkey", "source_band", F.col("c.tier").alias("capped_tier"), F.col("c.capped").alias("capped"), "factor_band")


@query("f16_flow_tests", "v_weather", """
SELECT cell_i, cell_j, ts, (degrees(atan2(-u, -v)) + 360) % 360 BETWEEN 247.5 AND 360 AS dry_sector, round(least(abs(v) / greatest(abs(u), 0.1), 1), 6) AS ratio FROM v_weather""")
def f16(spark, sf):
    return X.v_weather(spark, sf).select("cell_i", "cell_j", "ts", S.in_dry_sector(P.wind_from_deg(F.col("u"), F.col("v"))).alias("dry_sector"), rnd(S.flow_anomaly_ratio(F.abs("v"), F.abs("u"))).alias("ratio"))


@query("p17_contribution", "v_scores", "SELECT event_id, cand, component, round_even(value * weight, 4) AS contribution FROM v_scores")
def p17(spark, sf):
    return X.v_scores(spark, sf).select("event_id", "cand", "component", S.contribution(F.col("value"), F.col("weight")).alias("contribution"))


@query("h1_weighted_scores", "v_scores", """
g AS (SELECT event_id, cand, round_even(sum(value * weight), 4) AS score FROM v_scores GROUP BY ALL)
SELECT event_id, cand, score, CASE WHEN score >= 0.55 THEN 'MODERATE' WHEN score >= 0.30 THEN 'LOW' ELSE 'INSUFFICIENT' END AS tier, score >= 0.80 AS capped FROM g""")
def h1w(spark, sf):
    return attribution.score_components(X.v_scores(spark, sf), ["event_id", "cand"], S.SOURCE_EDGES, "MODERATE").select("event_id", "cand", "score", "tier", "capped")


# ------------------------------------------------------------------ factor diagnostics

_DIAG = """
ad AS (SELECT region_id, year, day_idx, sum(tmax * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM v_days WHERE day_idx BETWEEN 60 AND 180 GROUP BY ALL),
bd AS (SELECT region_id, year, day_idx, sum(tmax * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM v_second WHERE day_idx BETWEEN 60 AND 180 AND year BETWEEN 1995 AND 2000 GROUP BY ALL),
am AS (SELECT region_id, year, avg(v) AS m FROM ad GROUP BY ALL), bm AS (SELECT region_id, year, avg(v) AS m FROM bd GROUP BY ALL),
ev AS (SELECT region_id, m AS event_mean FROM am WHERE year = 2001), ofs AS (SELECT region_id, avg(am.m - bm.m) AS ofs FROM am JOIN bm USING (region_id, year) WHERE year IN (1999, 2000) GROUP BY 1),
st AS (SELECT region_id, avg(m) AS clim_mean, stddev_pop(m) AS clim_std FROM bm GROUP BY 1), pq AS (SELECT region_id, quantile_cont(v, 0.9) AS p90 FROM bd GROUP BY 1),
j AS (SELECT *, event_mean - ofs AS corrected FROM ev JOIN ofs USING (region_id) JOIN st USING (region_id) JOIN pq USING (region_id))
SELECT region_id, round(event_mean, 6) AS event_mean, round(ofs, 6) AS offset, round(corrected, 6) AS corrected, round(clim_mean, 6) AS clim_mean, round(clim_std, 6) AS clim_std, round(corrected - clim_mean, 6) AS anomaly,
(SELECT avg(CASE WHEN m < corrected THEN 1.0::DOUBLE ELSE 0 END) FROM bm WHERE bm.region_id = j.region_id) AS percentile, round((SELECT avg(CASE WHEN v < corrected THEN 1.0::DOUBLE ELSE 0 END) FROM bd WHERE bd.region_id = j.region_id), 6) AS pooled_percentile,
(SELECT count(*) FROM ad WHERE ad.region_id = j.region_id AND year = 2001 AND v > p90 + ofs) AS days_above, (SELECT count(*) FROM ad WHERE ad.region_id = j.region_id AND year = 2001) AS n_days FROM j"""


def _daily(df):
    w = df.where(F.col("day_idx").between(60, 180)).withColumn("w", F.cos(F.radians("lat"))).withColumnRenamed("tmax", "value")
    return materialise(attribution.window_means(w, ["region_id"]), "daily-means")


@query("a39_factor_diagnostics", "v_days v_second", "WITH " + _DIAG)
def a39(spark, sf):
    d = attribution.factor_diagnostics(_daily(X.v_days(spark, sf)), _daily(X.v_second(spark, sf)).where(F.col("year").between(1995, 2000)), "region_id", X.EVENT_YEAR, [1999, 2000])
    return d.select("region_id", *[rnd(c).alias(c) for c in ("event_mean", "offset", "corrected", "clim_mean", "clim_std", "anomaly")], "percentile", rnd("pooled_percentile").alias("pooled_percentile"), "days_above", "n_days")


@query("a40_percent_rank", "v_days", """
m AS (SELECT region_id, lat_i, lon_i, year, avg(tmax) AS m FROM v_days GROUP BY ALL)
SELECT e.region_id, e.lat_i, e.lon_i, avg(CASE WHEN b.m < e.m THEN 1.0::DOUBLE ELSE 0 END) AS pct FROM m e JOIN m b USING (region_id, lat_i, lon_i) WHERE e.year = 2001 AND b.year < 2001 GROUP BY ALL""")
def a40(spark, sf):
    m = X.v_days(spark, sf).groupBy("region_id", "lat_i", "lon_i", "year").agg(F.avg("tmax").alias("m"))
    e = m.where("year = 2001").select("region_id", "lat_i", "lon_i", F.col("m").alias("e"))
    return m.where("year < 2001").join(e, ["region_id", "lat_i", "lon_i"]).groupBy("region_id", "lat_i", "lon_i").agg(attribution.percent_rank(F.col("m"), F.col("e")).alias("pct"))


@query("a41_wind_climatology", "", """
g AS (SELECT l_suppkey // 50 AS region_id, year(l_shipdate) AS yr, l_shipdate::DATE AS d, 22.0::DOUBLE + 4 * (l_partkey % 4) AS lat, l_suppkey % 4 AS lon_i,
 avg(l_discount * 100 - 5) AS u, avg(l_tax * 100 - 4) AS v FROM lineitem WHERE month(l_shipdate) IN (6, 7) AND year(l_shipdate) <= 2001 GROUP BY ALL),
d AS (SELECT region_id, yr, d, sum(u * cos(radians(lat))) / sum(cos(radians(lat))) AS u, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM g GROUP BY ALL),
y AS (SELECT region_id, yr, avg(u) AS u, avg(v) AS v FROM d GROUP BY ALL),
c AS (SELECT region_id, avg(u) AS uc, avg(v) AS vc, count(*) AS n_years FROM y WHERE yr < 2001 GROUP BY 1)
SELECT region_id, coalesce(n_years, 0) AS n_years, round(sqrt(u * u + v * v), 6) AS speed, round((degrees(atan2(-u, -v)) + 360) % 360, 6) AS from_deg, round((degrees(atan2(-uc, -vc)) + 360) % 360, 6) AS clim_from_deg,
 round(u - uc, 6) AS du, round(v - vc, 6) AS dv, round(sqrt((u - uc) ** 2 + (v - vc) ** 2), 6) AS anomaly FROM y LEFT JOIN c USING (region_id) WHERE yr = 2001""")
def a41(spark, sf):
    li = X.table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_tax"])
    day = F.to_date("l_shipdate")
    cell = [F.expr("l_suppkey div 50").alias("region_id"), F.year(day).alias("year"), day.alias("day"), F.expr("22.0D + 4 * (l_partkey % 4)").alias("lat"), F.expr("l_suppkey % 4").alias("lon_i")]
    winds = li.where(F.month(day).isin(6, 7) & (F.year(day) <= 2001)).groupBy(*cell).agg(
        F.avg(F.col("l_discount") * 100 - 5).alias("u"), F.avg(F.col("l_tax") * 100 - 4).alias("v"))
    out = climate.wind_climatology(winds, ["region_id"], 2001)
    return out.select("region_id", "n_years", *[rnd(c).alias(c) for c in ("speed", "from_deg", "clim_from_deg", "du", "dv", "anomaly")])


# ------------------------------------------------------------------ factor hypotheses

_FACT = """
dg AS (SELECT p_partkey AS event_id, p_size / 50.0::DOUBLE AS rp, (p_partkey * 7) % 11 AS da, 10 AS nd, ((p_partkey * 13) % 31) / 30.0::DOUBLE AS ap, ((p_partkey * 17) % 31) / 30.0::DOUBLE AS wp, ((p_partkey * 5) % 40) / 10.0::DOUBLE AS fa, ((p_partkey * 3) % 50) / 10.0::DOUBLE AS fs, ((p_partkey * 11) % 31) / 30.0::DOUBLE AS dp FROM part),
cp AS (SELECT event_id, round_even(round_even(rp, 3) * 0.6::DOUBLE, 4) + round_even(round_even(da / 10.0::DOUBLE, 3) * 0.4::DOUBLE, 4) AS f1,
 round_even(round_even(greatest(0, 2 * ((1 - ap) - 0.5)), 3) * 0.7::DOUBLE, 4) + round_even(round_even(greatest(0, 2 * ((1 - wp) - 0.5)), 3) * 0.3::DOUBLE, 4) AS f2, round_even(round_even(least(fa / greatest(fs, 0.1), 1), 3), 4) AS f3,
 greatest(greatest(0, 2 * ((1 - dp) - 0.5)), greatest(0, 2 * ((1 - (1 - dp)) - 0.5))) AS hum FROM dg),
fc AS (SELECT event_id, unnest([{'f': 'F1', 'o': 1, 's': round_even(f1, 4), 'h': hum}, {'f': 'F2', 'o': 2, 's': round_even(f2, 4), 'h': hum}, {'f': 'F3', 'o': 3, 's': round_even(f3, 4), 'h': hum}, {'f': 'F4', 'o': 4, 's': round_even(round_even(hum, 3), 4), 'h': hum}, {'f': 'F5', 'o': 5, 's': 0.0::DOUBLE, 'h': hum}]) AS x FROM cp),
rk AS (SELECT event_id, x.f AS factor, CASE WHEN x.o <= 3 THEN 'warming_contributor' WHEN x.o = 4 THEN 'severity_framing' ELSE 'counter_evidence' END AS role, least(x.s, 1) AS score,
 CASE x.o WHEN 4 THEN CASE WHEN x.h >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END WHEN 5 THEN 'INSUFFICIENT' ELSE CASE WHEN x.s >= 0.5 THEN 'MODERATE' WHEN x.s >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END END AS tier,
 row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN x.o <= 3 THEN 0 ELSE x.o END, CASE WHEN x.o <= 3 THEN -x.s END, x.o) AS rank FROM fc)
"""


def _diagnostics(spark, sf):
    return X.table(spark, sf, "part", ["p_partkey", "p_size"]).select(
        F.col("p_partkey").alias("event_id"), (F.col("p_size") / 50.0).alias("ridge_pct"), F.expr("(p_partkey * 7) % 11").alias("days_above"), F.lit(10).alias("n_days"),
        F.expr("((p_partkey * 13) % 31) / 30.0D").alias("ant_pct"), F.expr("((p_partkey * 17) % 31) / 30.0D").alias("win_pct"), F.expr("((p_partkey * 5) % 40) / 10.0D").alias("flow_anomaly"),
        F.expr("((p_partkey * 3) % 50) / 10.0D").alias("flow_speed"), F.expr("((p_partkey * 11) % 31) / 30.0D").alias("dew_pct"), F.expr("-(p_size % 7) / 10.0D").alias("uhi_k"))


def _factors(spark, sf):
    return attribution.factor_scores(_diagnostics(spark, sf))


@query("h4_factor_hypotheses", "", "WITH " + _FACT + "SELECT event_id, factor, role, round(score, 4) AS score, tier FROM rk")
def h4(spark, sf):
    return _factors(spark, sf).select("event_id", "factor", "role", rnd("score", 4).alias("score"), "tier")


@query("t6_factor_ranks", "", "WITH " + _FACT + "SELECT event_id, factor, rank FROM rk")
def t6(spark, sf):
    return _factors(spark, sf).select("event_id", "factor", "rank")


@query("h5_discrimination", "", "WITH " + _FACT + """
SELECT a.event_id, a.factor AS first, b.factor AS second, round(abs(a.score - b.score), 4) AS gap, abs(a.score - b.score) < 0.15 AS undiscriminated FROM rk a JOIN rk b ON a.event_id = b.event_id WHERE a.rank = 1 AND b.rank = 2""")
def h5(spark, sf):
    return attribution.discrimination(attribution.factor_ladder(_diagnostics(spark, sf))).withColumn("gap", rnd("gap", 4))


# ------------------------------------------------------------------ data quality


@query("p16_constraint_violations", "v_dets v_events v_refs", """
d AS (SELECT det_id, event_id % 4 = 3 AS an, has_fp, CASE WHEN det_id % 9 <> 2 THEN 'base' END AS baseline, CASE WHEN det_id % 101 = 1 THEN 190 ELSE lon END AS lon, lat, t0, CASE WHEN det_id % 103 = 2 THEN t0 - INTERVAL 1 DAY ELSE t1 END AS t1, (det_id % 107) / 105.0::DOUBLE AS conf FROM v_dets),
x AS (SELECT 'detection' AS entity, det_id::VARCHAR AS key, unnest(list_filter([CASE WHEN an AND baseline IS NULL THEN 'anomaly needs baseline' END, CASE WHEN an AND NOT has_fp THEN 'anomaly needs footprint' END, CASE WHEN lon > 180 THEN 'longitude range' END, CASE WHEN t1 < t0 THEN 'end before start' END, CASE WHEN conf > 1 THEN 'confidence range' END], lambda z: z IS NOT NULL)) AS rule FROM d),
e AS (SELECT 'event', event_id::VARCHAR, unnest(list_filter([CASE WHEN event_id % 6 = 1 THEN 'location inside bbox' END, CASE WHEN event_id % 10 = 4 THEN 'at least one reference' END], lambda z: z IS NOT NULL)) FROM v_events),
r AS (SELECT 'reference', event_id::VARCHAR, 'reason required' FROM v_refs WHERE usability <> 'comparable' AND event_id % 2 = 0),
b AS (SELECT 'baseline', p_partkey::VARCHAR, unnest(list_filter([CASE WHEN p_partkey % 19 = 3 THEN 'period order' END, CASE WHEN p_size % 2 = 0 AND p_partkey % 7 = 0 THEN 'percentile needs value' END, CASE WHEN p_partkey % 7 <> 0 AND p_size * 2.5 > 100 THEN 'percentile range' END, CASE WHEN p_partkey % 23 - 1 < 0 THEN 'window not negative' END], lambda z: z IS NOT NULL)) FROM part)
SELECT * FROM x UNION ALL SELECT * FROM e UNION ALL SELECT * FROM r UNION ALL SELECT * FROM b""")
def p16(spark, sf):
    d = X.v_dets(spark, sf).select(
        "det_id", F.expr("event_id % 4 = 3").alias("is_anomaly"), "footprint", F.expr("case when det_id % 9 <> 2 then 'base' end").alias("baseline"), F.expr("case when det_id % 101 = 1 then 190D else lon end").alias("lon"), "lat", "t0",
        F.expr("case when det_id % 103 = 2 then t0 - make_dt_interval(1) else t1 end").alias("t1"), F.expr("(det_id % 107) / 105.0D").alias("confidence"))
    e = X.v_events(spark, sf).withColumn("e_lon", F.when(F.expr("event_id % 6 = 1"), F.col("e_lon") + 5).otherwise(F.col("e_lon"))).withColumn("n_references", F.when(F.expr("event_id % 10 = 4"), 0).otherwise(2))
    r = X.v_refs(spark, sf).withColumn("why", F.when(F.expr("event_id % 2 = 0"), F.lit("  ")).otherwise(F.col("why")))
    b = X.table(spark, sf, "part", ["p_partkey", "p_size"]).select(
        "p_partkey", F.expr("1991").alias("period_start"), F.expr("case when p_partkey % 19 = 3 then 1990 else 2020 end").alias("period_end"), F.expr("case when p_size % 2 = 0 then 'percentile' else 'mean' end").alias("statistic"),
        F.expr("case when p_partkey % 7 <> 0 then p_size * 2.5D end").alias("percentile"), F.expr("p_partkey % 23 - 1").alias("window_days"))
    v = quality.violations
    return (v(d, "detection", "det_id", quality.detection_rules()).unionByName(v(e, "event", "event_id", quality.event_rules()))
            .unionByName(v(r, "reference", "event_id", quality.reference_rules())).unionByName(v(b, "baseline", "p_partkey", quality.baseline_rules())))


@query("h6_claim_consistency", "", "WITH " + _FACT + """,
f AS (SELECT *, CASE WHEN event_id % 13 = 4 THEN 'Urban fabric' ELSE factor END AS nm, event_id % 17 = 5 AS ext, CASE WHEN event_id % 11 = 3 THEN 0 ELSE 2 END AS nd FROM rk)
SELECT 'factor' AS entity, event_id || '-' || factor AS key, unnest(list_filter([CASE WHEN nd < 1 THEN 'at least one diagnostic' END, CASE WHEN role = 'warming_contributor' AND nm = 'Urban fabric' THEN 'urban never a contributor' END, CASE WHEN ext AND score > 0 THEN 'external attribution unscored' END], lambda z: z IS NOT NULL)) AS rule FROM f""")
def h6(spark, sf):
    f = _factors(spark, sf).select(
        F.concat("event_id", F.lit("-"), "factor").alias("key"), "role", "score", F.when(F.expr("event_id % 13 = 4"), "Urban fabric").otherwise(F.col("factor")).alias("factor_name"),
        F.expr("event_id % 17 = 5").alias("external"), F.when(F.expr("event_id % 11 = 3"), 0).otherwise(2).alias("n_diagnostics"))
    return quality.violations(f, "factor", "key", quality.factor_rules())


# ------------------------------------------------------------------ event reports

_CAT = """
pl AS (SELECT event_id, avg(lon) AS lon, avg(lat) AS lat, avg(m_rate) / 300 AS rate FROM v_dets WHERE event_id % 3 <> 2 GROUP BY 1), ht AS (SELECT event_id, avg(m_mass) / 10 AS anomaly, max(m_mass) AS peak FROM v_dets WHERE event_id % 4 = 3 GROUP BY 1),
bo AS (SELECT DISTINCT event_id FROM v_dets WHERE event_id % 5 <> 1), ct AS (SELECT e.*, pl.lon AS pl_lon, pl.lat AS pl_lat, rate, anomaly, peak, (rate IS NOT NULL OR anomaly IS NOT NULL) AND bo.event_id IS NOT NULL AS act FROM v_events e LEFT JOIN pl USING (event_id) LEFT JOIN ht USING (event_id) LEFT JOIN bo ON bo.event_id = e.event_id)
"""


@query("j19_event_catalogue", "v_events v_dets", _CAT + """
SELECT event_id, name, CASE WHEN act THEN 'active' ELSE 'pending' END AS status, round(CASE WHEN act AND NOT is_area THEN coalesce(pl_lon, e_lon) ELSE e_lon END, 6) AS lon, round(CASE WHEN act AND NOT is_area THEN coalesce(pl_lat, e_lat) ELSE e_lat END, 6) AS lat,
CASE WHEN NOT act THEN 'pending' WHEN is_area THEN printf('T2M +%.1f K, peak %.1f C', anomaly, peak) ELSE 'CH4 ' || CASE WHEN abs(rate) < 1 THEN printf('%.2f', rate) ELSE printf('%.1f', rate) END || ' t/hr' END AS headline FROM ct""")
def j19(spark, sf):
    d = X.v_dets(spark, sf)
    pl = d.where("event_id % 3 <> 2").groupBy("event_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), (F.avg(F.col("measurements")["rate"]) / 300).alias("rate"))
    ht = d.where("event_id % 4 = 3").groupBy("event_id").agg((F.avg(F.col("measurements")["mass"]) / 10).alias("anomaly"), F.max(F.col("measurements")["mass"]).alias("peak"))
    c = reporting.event_catalogue(X.v_events(spark, sf), pl, ht, d.where("event_id % 5 <> 1").select("event_id"))
    return c.withColumn("lon", rnd("lon")).withColumn("lat", rnd("lat"))


@query("h7_quantity_tiers", "v_dets", """
c AS (SELECT event_id, avg(m_mass) > 24.5 AS v1, avg(m_rate) > 250 AS v3a, count(*) > 590 AS v3b FROM v_dets GROUP BY 1)
SELECT event_id, q.q AS quantity, q.l AS lane, q.t AS tier FROM (SELECT event_id, unnest([{'q': 'C1', 'l': 'AIR', 't': CASE WHEN v1 THEN 'VALIDATED' ELSE 'NOT VALIDATED' END}, {'q': 'C2', 'l': 'AIR', 't': CASE WHEN v3a AND v3b THEN 'VALIDATED' ELSE 'NOT VALIDATED' END},
{'q': 'C3', 'l': 'AIR', 't': 'NOT VALIDATED'}, {'q': 'C4', 'l': 'AIR', 't': 'NOT VALIDATED'}, {'q': 'V2', 'l': 'AIR', 't': 'CONSISTENCY NOT CLAIMED'}, {'q': 'LST', 'l': 'LST', 't': 'CROSS-CHECKED (ceiling)'}, {'q': 'UHI', 'l': 'LST', 't': 'CROSS-CHECKED (ceiling)'}]) AS q FROM c)""")
def h7(spark, sf):
    m = F.col("measurements")
    c = X.v_dets(spark, sf).groupBy("event_id").agg((F.avg(m["mass"]) > 24.5).alias("v1"), (F.avg(m["rate"]) > 250).alias("v3a"), (F.count("*") > 590).alias("v3b"))
    return reporting.quantity_tiers(c)


@query("h8_scope_caveats", "v_quant v_refs", """
SELECT scene_id AS event_id, thr, CASE WHEN thr >= 150 THEN 'cluster_fraction' ELSE 'context_only' END AS kind, CASE WHEN thr >= 150 THEN round(q_t_h / bias / 163 * 100, 6) END AS fraction_low_pct, CASE WHEN thr >= 150 THEN round(q_t_h / 163 * 100, 6) END AS fraction_high_pct FROM v_quant""")
def h8(spark, sf):
    from .q_plume import _foot, _quant

    b = plume.amplitude_bias(_foot(spark, sf), ["scene_id", "thr"]).select("scene_id", "thr", "bias_ime")
    r = _quant(spark, sf).join(b, ["scene_id", "thr"]).select(
        F.struct("scene_id", "thr").alias("event_id"), F.lit(163.0).alias("total"), F.when(F.col("thr") >= 150, 18.0).alias("uncertainty"), F.lit(12).alias("n_sources"), F.col("q_t_h").alias("own"), (F.col("q_t_h") / F.col("bias_ime")).alias("calibrated"))
    c = reporting.scope_caveats(r)
    return c.select("event_id.scene_id", "event_id.thr", "kind", rnd("fraction_low_pct").alias("fraction_low_pct"), rnd("fraction_high_pct").alias("fraction_high_pct")).withColumnRenamed("scene_id", "event_id")


@query("h9_event_detail", "v_quant", """
sw AS (SELECT scene_id, max(q_t_h) FILTER (n_px >= 5) AS hi, min(q_t_h) FILTER (n_px >= 5) AS lo, count(*) FILTER (n_px >= 5) AS n_used FROM v_quant GROUP BY 1),
t AS (SELECT q.*, CASE WHEN n_used >= 2 THEN (hi - lo) / q_t_h ELSE 0 END AS spread, ln(u10) * 0.1::DOUBLE / u_eff AS alpha1, 1.7::DOUBLE / u10 / u_eff AS u10s FROM v_quant q JOIN sw USING (scene_id) WHERE thr = 100),
s AS (SELECT *, sqrt(wind_total ** 2 + (spread / 2) ** 2) AS sg FROM t)
SELECT scene_id AS event_id, x.t AS term, round(q_t_h / bias, 6) AS q_cal, round(q_t_h / bias * (1 - sg) / bias, 6) AS cal_low, round(q_t_h * (1 + sg) / bias, 6) AS cal_high, CASE WHEN bias >= 1 THEN 'over' ELSE 'under' END AS amplitude, round(x.p, 6) AS pct, round(x.s, 6) AS share
FROM (SELECT *, unnest([{'t': 'alpha1', 'p': alpha1 * 100, 's': least(1, alpha1 / sg)}, {'t': 'u10', 'p': u10s * 100, 's': least(1, u10s / sg)}, {'t': 'mask', 'p': spread / 2 * 100, 's': least(1, spread / 2 / sg)}, {'t': 'mf_amplitude', 'p': NULL, 's': 1}]) AS x FROM s)""")
def h9(spark, sf):
    from .q_plume import CENTRAL, _foot, _quant, _spread

    b = plume.amplitude_bias(_foot(spark, sf, (CENTRAL,)), ["scene_id"]).select("scene_id", F.col("bias_ime").alias("bias"))
    j = _quant(spark, sf, (CENTRAL,)).join(b, "scene_id").join(_spread(spark, sf), "scene_id").withColumn("q_cal", F.col("q_t_h") / F.col("bias"))
    j = j.withColumn("b", plume.rate_bounds(F.col("q_t_h"), F.col("q_cal"), F.col("wind.total"), F.col("spread")))
    r = j.select(F.col("scene_id").alias("event_id"), F.col("q_t_h").alias("q"), "q_cal", "b.low", "b.high", "bias", "b.sigma", F.col("wind.alpha1_term").alias("alpha1"), F.col("wind.u10_term").alias("u10"), "spread")
    d = reporting.event_detail(r)
    return d.select("event_id", "term", "amplitude", *[rnd(c).alias(c) for c in ("q_cal", "cal_low", "cal_high", "pct", "share")])
