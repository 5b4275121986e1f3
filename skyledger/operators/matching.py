"""Detections against benchmark events, scoring, and regression checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo


def time_overlap(t0: Column, t1: Column, e0: Column, e1: Column, tol_min: int) -> Column:
    """Interval overlap within a tolerance; an event without an end is still running."""
    tol = F.expr(f"INTERVAL {tol_min} MINUTES")
    end = F.coalesce(t1, t0)
    return F.when(e1.isNull(), end >= e0 - tol).otherwise((t0 <= e1 + tol) & (end >= e0 - tol))


def judge(
    dets: DataFrame, events: DataFrame, tol_m: float = C.SPATIAL_TOLERANCE_M, tol_min: int = C.TEMPORAL_TOLERANCE_MIN
) -> DataFrame:
    """Every detection beside its event, with ``matched``, ``reason`` and ``dist_m``.

    Tests run in order: type, time, then space. Area events compare boxes,
    others compare distance with the event's own precision where it has one.
    """
    j = dets.join(events, "event_id")
    dist = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("e_lon"), F.col("e_lat"))
    limit = F.coalesce(F.col("precision_km") * 1000.0, F.lit(tol_m))
    near = F.when(
        F.col("is_area"),
        F.when(F.col("footprint").isNull(), F.lit(False)).otherwise(geo.area_overlap_match(F.col("footprint"), F.col("e_box"))),
    ).otherwise(dist <= limit)
    reason = (
        F.when(~F.array_contains("expected_types", F.col("type")), "type")
        .when(~time_overlap(F.col("t0"), F.col("t1"), F.col("e_t0"), F.col("e_t1"), tol_min), "time")
        .when(F.col("is_area") & F.col("footprint").isNull(), "no footprint")
        .when(~near, "space")
        .otherwise("matched")
    )
    return j.withColumn("dist_m", dist).withColumn("reason", reason).withColumn("matched", F.col("reason") == "matched")


def run_scores(judged: DataFrame, runs: DataFrame) -> DataFrame:
    """Recall over runnable events, precision, mean latency of a whole run.

    ``runs`` has ``event_id, status, latency_s``; detections of events that did
    not run are ignored.
    """
    per = judged.groupBy("event_id").agg(
        F.count("*").alias("n_det"), F.count(F.when(F.col("matched"), 1)).alias("n_match")
    )
    r = runs.join(per, "event_id", "left")
    ran = F.col("status") == "ran"
    agg = r.agg(
        F.count("*").alias("n_events"),
        F.count(F.when(F.col("status") == "not_runnable", 1)).alias("n_not_runnable"),
        F.count(F.when(F.col("status") == "error", 1)).alias("n_errored"),
        F.count(F.when(ran & (F.col("n_match") > 0), 1)).alias("n_recalled"),
        F.coalesce(F.sum(F.when(ran, F.col("n_det"))), F.lit(0)).alias("n_detections"),
        F.coalesce(F.sum(F.when(ran, F.col("n_match"))), F.lit(0)).alias("n_matched"),
        F.avg(F.when(F.col("status") != "not_runnable", F.col("latency_s"))).alias("mean_latency_s"),
    )
    runnable = F.col("n_events") - F.col("n_not_runnable")
    return agg.select(
        "*", runnable.alias("n_runnable"),
        F.when(runnable > 0, F.col("n_recalled") / runnable).otherwise(0.0).alias("recall"),
        F.when(F.col("n_detections") > 0, F.col("n_matched") / F.col("n_detections")).otherwise(0.0).alias("precision"),
    )


def quantification_outcomes(judged: DataFrame, references: DataFrame) -> DataFrame:
    """Mean relative error per (event, measurement), only against comparable references.

    ``references``: ``event_id, name, value, usability, why``; detections carry a
    ``measurements`` map.
    """
    m = judged.where("matched").select("event_id", F.explode("measurements").alias("name", "predicted"))
    j = references.join(m, ["event_id", "name"], "left")
    comparable = F.col("usability") == "comparable"
    err = F.when(
        comparable & (F.col("value") != 0), F.abs(F.col("predicted") - F.col("value")) / F.abs("value")
    )
    return j.groupBy("event_id", "name", "usability").agg(
        F.first(F.when(comparable, F.lit(None).cast("string")).otherwise(F.col("why")), ignorenulls=True).alias("why"),
        F.avg(err).alias("mape"), F.count(err).alias("n_pairs"),
    )


def regression_checks(fresh: DataFrame, committed: DataFrame, rules: DataFrame) -> DataFrame:
    """Fresh against committed values by metric; nothing to compare with is an error row.

    ``fresh``/``committed``: ``event_id, metric, value``; ``rules``: ``metric, kind, tol``.
    """
    j = fresh.withColumnRenamed("value", "fresh").join(rules, "metric").join(
        committed.withColumnRenamed("value", "committed"), ["event_id", "metric"], "left"
    )
    a, b, tol = F.col("fresh"), F.col("committed"), F.col("tol")
    ok = (
        F.when(b.isNull(), F.lit(False))
        .when(F.col("kind") == "fractional", (b != 0) & (F.abs(a - b) / F.abs(F.when(b != 0, b)) <= tol))
        .when(F.col("kind") == "distance_km", a <= tol)
        .otherwise(F.abs(a - b) <= tol)
    )
    return j.withColumn("passed", F.coalesce(ok, F.lit(False))).withColumn(
        "status", F.when(b.isNull(), "nothing committed").otherwise("compared")
    )


def scoreboard(runs: DataFrame, judged: DataFrame, checks: DataFrame) -> DataFrame:
    """Per event: nearest matched distance, checks passed and whether all is green."""
    best = judged.groupBy("event_id").agg(F.min(F.when(F.col("matched"), F.col("dist_m"))).alias("best_m"))
    c = checks.groupBy("event_id").agg(
        F.count("*").alias("n_checks"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"),
        F.bool_and("passed").alias("_all"),
    )
    return runs.join(best, "event_id", "left").join(c, "event_id", "left").select(
        "event_id", "status", (F.col("best_m") / 1000.0).alias("best_km"),
        F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"),
        (F.coalesce("_all", F.lit(True)) & (F.col("status") != "error")).alias("green"),
    )


def runnable_status(events: DataFrame, recipes: Column, launch: str) -> DataFrame:
    """Whether an event can be evaluated, and if not, why."""
    end = F.coalesce("e_t1", "e_t0")
    status = (
        F.when(F.col("phenomenon") != "emission", F.when(recipes, "ran").otherwise("not_runnable"))
        .when(F.col("acquisition").isNull(), "not_runnable")
        .when(recipes, "ran").otherwise("not_runnable")
    )
    reason = (
        F.when((F.col("phenomenon") != "emission") & ~recipes, "no recipe for this phenomenon")
        .when(F.col("phenomenon") != "emission", F.lit(None).cast("string"))
        .when(F.col("acquisition").isNull() & (end < F.lit(launch).cast("timestamp_ntz")), "predates the sensor")
        .when(F.col("acquisition").isNull(), "no acquisition pinned")
        .when(~recipes, "no recipe for this acquisition")
    )
    return events.withColumn("status", status).withColumn("status_reason", reason)
