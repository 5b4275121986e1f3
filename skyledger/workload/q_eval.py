"""Detections against events, scoring, regression and runnable checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo
from ..operators import matching
from . import fixtures as X
from .registry import query, rnd

_JUDGE = """
hv AS (SELECT d.*, e.*EXCLUDE (event_id), 6371008.8::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) AS dist_m FROM (SELECT d.*, sin(radians(e_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(e_lat)) * sin(radians(e_lon - lon) / 2) ** 2 AS h FROM v_dets d JOIN v_events e USING (event_id)) d JOIN v_events e USING (event_id)),
ov AS (SELECT *, (least(f2, b2) - greatest(f0, b0)) * cos(radians((greatest(f1, b1) + least(f3, b3)) / 2)) * (least(f3, b3) - greatest(f1, b1)) AS ia,
 (f2 - f0) * cos(radians((f1 + f3) / 2)) * (f3 - f1) AS fa, (b2 - b0) * cos(radians((b1 + b3) / 2)) * (b3 - b1) AS ea, greatest(f0, b0) < least(f2, b2) AND greatest(f1, b1) < least(f3, b3) AS touch FROM hv),
jd AS (SELECT *, CASE WHEN NOT list_contains(expected_types, type) THEN 'type'
 WHEN NOT (CASE WHEN e_t1 IS NULL THEN coalesce(t1, t0) >= e_t0 - INTERVAL 60 MINUTE ELSE t0 <= e_t1 + INTERVAL 60 MINUTE AND coalesce(t1, t0) >= e_t0 - INTERVAL 60 MINUTE END) THEN 'time'
 WHEN is_area AND NOT has_fp THEN 'no footprint' WHEN is_area AND NOT (touch AND ia >= 0.5 * least(fa, ea)) THEN 'space' WHEN NOT is_area AND NOT dist_m <= coalesce(precision_km * 1000, 5000) THEN 'space' ELSE 'matched' END AS reason FROM ov)
"""


def _judged(spark, sf):
    return matching.judge(X.v_dets(spark, sf), X.v_events(spark, sf))


@query("j15_match_detections", "v_dets v_events", _JUDGE + "SELECT det_id, event_id, reason, round(dist_m, 4) AS dist_m FROM jd")
def j15(spark, sf):
    return _judged(spark, sf).select("det_id", "event_id", "reason", rnd("dist_m", 4).alias("dist_m"))


@query("j16_point_criterion", "v_dets v_events", _JUDGE + """
SELECT event_id, count(*) FILTER (dist_m <= coalesce(precision_km * 1000, 5000)) AS n_near, round(min(dist_m), 4) AS nearest_m, round(avg(dist_m), 4) AS mean_m FROM jd WHERE NOT is_area GROUP BY 1""")
def j16(spark, sf):
    near = F.col("dist_m") <= F.coalesce(F.col("precision_km") * 1000.0, F.lit(C.SPATIAL_TOLERANCE_M))
    return _judged(spark, sf).where(~F.col("is_area")).groupBy("event_id").agg(
        F.count(F.when(near, 1)).alias("n_near"), rnd(F.min("dist_m"), 4).alias("nearest_m"), rnd(F.avg("dist_m"), 4).alias("mean_m"))


@query("j17_area_criterion", "v_dets v_events", _JUDGE + """
SELECT event_id, count(*) FILTER (has_fp) AS n_footprints, count(*) FILTER (has_fp AND touch AND ia >= 0.5 * least(fa, ea)) AS n_overlap FROM jd WHERE is_area GROUP BY 1""")
def j17(spark, sf):
    j = X.v_dets(spark, sf).join(X.v_events(spark, sf), "event_id").where("is_area")
    return j.groupBy("event_id").agg(F.count("footprint").alias("n_footprints"), F.count(
        F.when(geo.area_overlap_match(F.col("footprint"), F.col("e_box")), 1)).alias("n_overlap"))


@query("u4_box_intersection", "v_dets v_events", """
SELECT det_id, greatest(f0, b0) AS min_lon, greatest(f1, b1) AS min_lat, least(f2, b2) AS max_lon, least(f3, b3) AS max_lat FROM v_dets JOIN v_events USING (event_id) WHERE has_fp""")
def u4(spark, sf):
    j = X.v_dets(spark, sf).join(X.v_events(spark, sf), "event_id").where("footprint is not null")
    return j.select("det_id", geo.intersection(F.col("footprint"), F.col("e_box")).alias("i")).select("det_id", "i.*")


@query("j18_unmatched_detections", "v_dets v_events", _JUDGE + "SELECT det_id, event_id FROM jd WHERE reason <> 'matched'")
def j18(spark, sf):
    d = X.v_dets(spark, sf)
    return d.join(_judged(spark, sf).where("matched").select("det_id"), "det_id", "left_anti").select("det_id", "event_id")


@query("a42_run_scores", "v_dets v_events v_runs", _JUDGE + """,
p AS (SELECT event_id, count(*) AS nd, count(*) FILTER (reason = 'matched') AS nm FROM jd GROUP BY 1), r AS (SELECT * FROM v_runs LEFT JOIN p USING (event_id)),
s AS (SELECT count(*) AS n_events, count(*) FILTER (status = 'not_runnable') AS n_not_runnable, count(*) FILTER (status = 'error') AS n_errored, count(*) FILTER (status = 'ran' AND nm > 0) AS n_recalled,
 coalesce(sum(nd) FILTER (status = 'ran'), 0)::BIGINT AS n_detections, coalesce(sum(nm) FILTER (status = 'ran'), 0)::BIGINT AS n_matched, avg(latency_s) FILTER (status <> 'not_runnable') AS mean_latency_s FROM r)
SELECT *, n_events - n_not_runnable AS n_runnable, round(n_recalled / (n_events - n_not_runnable), 6) AS recall, round(n_matched / n_detections, 6) AS precision FROM s""")
def a42(spark, sf):
    s = matching.run_scores(_judged(spark, sf), X.v_runs(spark, sf))
    return s.withColumn("recall", rnd("recall")).withColumn("precision", rnd("precision"))


@query("a43_quantification", "v_dets v_events v_refs", _JUDGE + """,
m AS (SELECT event_id, 'rate' AS name, m_rate AS p FROM jd WHERE reason = 'matched' UNION ALL SELECT event_id, 'mass', m_mass FROM jd WHERE reason = 'matched'),
x AS (SELECT r.*, CASE WHEN usability = 'comparable' AND value <> 0 THEN abs(p - value) / abs(value) END AS err FROM v_refs r LEFT JOIN m USING (event_id, name))
SELECT event_id, name, usability, any_value(CASE WHEN usability <> 'comparable' THEN why END) AS why, round(avg(err), 6) AS mape, count(err) AS n_pairs FROM x GROUP BY ALL""")
def a43(spark, sf):
    q = matching.quantification_outcomes(_judged(spark, sf), X.v_refs(spark, sf))
    return q.withColumn("mape", rnd("mape"))


RULES = {"q": ("fractional", C.TOL_Q_FRACTION), "pearson": ("absolute", C.TOL_PEARSON), "centroid": ("distance_km", C.TOL_CENTROID_KM), "extent": ("fractional", C.TOL_EXTENT_FRACTION)}
_CHECK = """
fr AS (SELECT p_partkey // 4 AS event_id, ['q', 'pearson', 'centroid', 'extent'][p_partkey % 4 + 1] AS metric, p_retailprice AS fresh FROM part),
cm AS (SELECT p_partkey // 4 AS event_id, ['q', 'pearson', 'centroid', 'extent'][p_partkey % 4 + 1] AS metric, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_retailprice * (1 + (p_size - 25) / 1500.0::DOUBLE) END AS committed FROM part WHERE p_partkey % 23 <> 0),
ck AS (SELECT fr.*, committed, kind, tol, coalesce(CASE WHEN committed IS NULL THEN false WHEN kind = 'fractional' THEN committed <> 0 AND abs(fresh - committed) / abs(nullif(committed, 0)) <= tol WHEN kind = 'distance_km' THEN fresh <= tol ELSE abs(fresh - committed) <= tol END, false) AS passed,
 CASE WHEN committed IS NULL THEN 'nothing committed' ELSE 'compared' END AS status FROM fr JOIN (VALUES ('q', 'fractional', 0.01::DOUBLE), ('pearson', 'absolute', 0.01), ('centroid', 'distance_km', 0.5), ('extent', 'fractional', 0.01)) t(metric, kind, tol) USING (metric) LEFT JOIN cm USING (event_id, metric))
"""


def _checks(spark, sf):
    p = X.table(spark, sf, "part", ["p_partkey", "p_retailprice", "p_size"])
    metric = F.expr("element_at(array('q', 'pearson', 'centroid', 'extent'), cast(p_partkey % 4 as int) + 1)")
    fresh = p.select(F.expr("p_partkey div 4").alias("event_id"), metric.alias("metric"), F.col("p_retailprice").alias("value"))
    committed = p.where("p_partkey % 23 <> 0").select(F.expr("p_partkey div 4").alias("event_id"), metric.alias("metric"), F.expr(
        "case when p_partkey % 17 = 0 then 0D else p_retailprice * (1 + (p_size - 25) / 1500.0D) end").alias("value"))
    rules = spark.createDataFrame([(m, k, t) for m, (k, t) in RULES.items()], "metric string, kind string, tol double")
    return matching.regression_checks(fresh, committed, rules)


@query("j20_regression_checks", "", "WITH " + _CHECK + "SELECT event_id, metric, kind, passed, status FROM ck")
def j20(spark, sf):
    return _checks(spark, sf).select("event_id", "metric", "kind", "passed", "status")


@query("a44_scoreboard", "v_dets v_events v_runs", _JUDGE + "," + _CHECK + """,
b AS (SELECT event_id, min(dist_m) FILTER (reason = 'matched') AS best FROM jd GROUP BY 1), k AS (SELECT event_id % 25 AS event_id, count(*) AS n, count(*) FILTER (passed) AS np, bool_and(passed) AS ok FROM ck GROUP BY 1)
SELECT r.event_id, r.status, round(best / 1000, 6) AS best_km, coalesce(n, 0) AS n_checks, coalesce(np, 0) AS n_passed, coalesce(ok, true) AND r.status <> 'error' AS green FROM v_runs r LEFT JOIN b USING (event_id) LEFT JOIN k USING (event_id)""")
def a44(spark, sf):
    checks = _checks(spark, sf).withColumn("event_id", F.col("event_id") % 25)
    s = matching.scoreboard(X.v_runs(spark, sf), _judged(spark, sf), checks)
    return s.withColumn("best_km", rnd("best_km"))


@query("p15_runnable_events", "v_events v_dets", """
n AS (SELECT event_id, count(*) AS n_det FROM v_dets GROUP BY 1)
SELECT event_id, n_det, CASE WHEN phenomenon <> 'emission' AND has_recipe THEN 'ran' WHEN phenomenon <> 'emission' THEN 'not_runnable' WHEN acquisition IS NULL THEN 'not_runnable' WHEN has_recipe THEN 'ran' ELSE 'not_runnable' END AS status,
CASE WHEN phenomenon <> 'emission' AND NOT has_recipe THEN 'no recipe for this phenomenon' WHEN phenomenon <> 'emission' THEN NULL WHEN acquisition IS NULL AND coalesce(e_t1, e_t0) < TIMESTAMP '1998-07-14 00:00:00' THEN 'predates the sensor'
WHEN acquisition IS NULL THEN 'no acquisition pinned' WHEN NOT has_recipe THEN 'no recipe for this acquisition' END AS status_reason FROM v_events LEFT JOIN n USING (event_id)""")
def p15(spark, sf):
    e = matching.runnable_status(X.v_events(spark, sf), F.col("has_recipe"), "1998-07-14 00:00:00")
    n = X.v_dets(spark, sf).groupBy("event_id").agg(F.count("*").alias("n_det"))
    return e.join(n, "event_id", "left").select("event_id", "n_det", "status", "status_reason")
