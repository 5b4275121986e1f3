"""Runs of consecutive days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def anchored_run(days: DataFrame, anchors: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Longest run of days at or above a threshold around an anchor day.

    ``days`` has the keys, ``pos`` (consecutive integers of the computed axis)
    and ``area_frac``; ``anchors`` has the keys and ``anchor``. The result has
    one row per anchor with a status; ``touches_edge`` marks a lower bound.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    span = days.groupBy(*keys).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    hit = days.where(F.col("area_frac") >= threshold).withColumn("_isle", F.col("pos") - F.row_number().over(w))
    isles = hit.groupBy(*keys, "_isle").agg(F.min("pos").alias("run_start"), F.max("pos").alias("run_end"))
    at = anchors.join(span, keys, "left").join(
        days.select(*keys, F.col("pos").alias("anchor"), F.col("area_frac").alias("_f")), [*keys, "anchor"], "left"
    )
    inside = (F.col("anchor") >= F.col("run_start")) & (F.col("anchor") <= F.col("run_end"))
    found = at.select(*keys, "anchor").join(isles, keys).where(inside).select(*keys, "anchor", "run_start", "run_end")
    return at.join(found, [*keys, "anchor"], "left").select(
        *keys, "anchor",
        F.when(F.col("_f").isNull(), "anchor not computed")
        .when(F.col("_f") < threshold, "anchor below threshold").otherwise("ok").alias("status"),
        "run_start", "run_end", (F.col("run_end") - F.col("run_start") + 1).alias("n_days"),
        ((F.col("run_start") == F.col("_first")) | (F.col("run_end") == F.col("_last"))).alias("touches_edge"),
    )


def gap_runs(days: DataFrame, keys: list[str], threshold: float, max_gap: int = 1) -> DataFrame:
    """Hit days with a run number; up to ``max_gap`` misses do not end a run.

    ``pos`` is the position in list order, so a run may cross a year's end.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    hit = days.where(F.col("area_frac") >= threshold)
    new = F.when(F.col("pos") - F.lag("pos").over(w) > max_gap + 1, 1).otherwise(0)
    return hit.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w)).drop("_new")


def summarise_runs(hits: DataFrame, keys: list[str], min_days: int = 3) -> DataFrame:
    """Score, peak day, largest anomaly and mean centroid per run with enough hits."""
    first_peak = F.struct(F.col("area_frac"), -F.col("pos"))
    return (
        hits.groupBy(*keys, "run_id")
        .agg(
            F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_days"),
            F.sum(F.col("area_frac") * F.col("severity")).alias("score"),
            F.max("area_frac").alias("peak_area_frac"), F.max_by("pos", first_peak).alias("peak_pos"),
            F.max("peak_anomaly").alias("peak_anomaly"),
            F.avg("centroid_i").alias("centroid_i"), F.avg("centroid_j").alias("centroid_j"),
        )
        .where(F.col("n_days") >= min_days)
    )


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an ordering (a distributed top-k)."""
    return df.orderBy(*order).limit(n)
