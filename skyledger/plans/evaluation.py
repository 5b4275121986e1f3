"""Evaluate a detection function against benchmark events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import matching
from ..session import materialise


def run_evaluation(
    detector: Callable[[DataFrame], DataFrame], events: DataFrame, references: DataFrame, checks: DataFrame, launch: str,
    tol_m: float = C.SPATIAL_TOLERANCE_M, tol_min: int = C.TEMPORAL_TOLERANCE_MIN,
) -> dict[str, DataFrame]:
    """Apply ``detector`` to the runnable events, match, score and compare.

    ``detector`` maps events to detections and is applied with
    ``DataFrame.transform``; ``checks`` are regression rows from
    ``matching.regression_checks``. Events that cannot run keep their reason
    and stay out of the recall.
    """
    status = matching.runnable_status(events, F.col("has_recipe"), launch)
    runs = status.select("event_id", "status", "status_reason", F.lit(None).cast("double").alias("latency_s"))
    runnable = events.join(status.where("status = 'ran'").select("event_id"), "event_id", "left_semi")
    judged = materialise(matching.judge(runnable.transform(detector), events, tol_m, tol_min), "judged")
    return {
        "judged": judged,
        "runs": runs,
        "scores": matching.run_scores(judged, runs),
        "quantification": matching.quantification_outcomes(judged, references),
        "scoreboard": matching.scoreboard(runs, judged, checks),
    }
