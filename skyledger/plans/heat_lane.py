"""Heat lane of many regions at once: daily table, peak, anomaly, duration, extent, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import climate, runs
from ..session import materialise

DEFAULT_VARIANTS = [("central", 1991, 2020, 10), ("early", 1991, 2005, 10), ("late", 2006, 2020, 10), ("wide", 1991, 2020, 15)]


def heat_lane(
    grid: DataFrame, land: DataFrame, anchors: DataFrame, event_year: int, threshold: float,
    window: tuple[int, int], variants=DEFAULT_VARIANTS, n_days: int = 365, offset_k: float = C.KELVIN,
) -> dict[str, DataFrame]:
    """Run the lane for every region in ``grid``.

    ``grid``: ``region_id, lat_i, lon_i, year, day_idx, tmax``; ``land`` adds
    ``lat, lon, lsm`` per cell; ``anchors``: ``region_id, anchor``. ``window``
    is the event window in day positions. The daily table is written once and
    feeds every figure.
    """
    clim = climate.window_climatology(grid, event_year, variants, n_days)
    cells = climate.lane_cells(clim, land, offset_k)
    days = materialise(climate.lane_days(cells, land), "lane-days")
    inside = days.where(F.col("day_idx").between(*window))
    central = inside.where("variant = 'central'")
    first = lambda v: F.struct(F.col(v), -F.col("day_idx"))
    summary = central.groupBy("region_id").agg(
        F.max("peak_tmax").alias("peak_tmax"), F.max_by("day_idx", first("peak_tmax")).alias("peak_day"),
        F.max_by("peak_cell", first("peak_tmax")).alias("peak_cell"),
        F.max("mean_anomaly").alias("peak_regional_anomaly"), F.avg("mean_anomaly").alias("window_mean_anomaly"),
        F.max("peak_anomaly").alias("peak_cell_anomaly"),
        F.max_by("day_idx", first("area_frac")).alias("extent_day"), F.bround(F.max("extent_km2"), -2).alias("extent_km2"),
    )
    duration = runs.anchored_run(
        days.where("variant = 'central'").select("region_id", F.col("day_idx").alias("pos"), "area_frac"), anchors, threshold, ["region_id"])
    per = inside.groupBy("region_id", "variant").agg(F.avg("mean_anomaly").alias("m"), F.max("extent_km2").alias("e"))
    pick = lambda n, c: F.max(F.when(F.col("variant") == n, F.col(c)))
    budget = per.groupBy("region_id").agg(
        pick("central", "m").alias("central"), (F.abs(pick("early", "m") - pick("late", "m")) / 2).alias("half_spread"),
        F.abs(pick("wide", "m") - pick("central", "m")).alias("window_shift"),
        pick("early", "e").alias("extent_early"), pick("late", "e").alias("extent_late"),
    )
    return {"days": days, "summary": summary, "duration": duration, "budget": budget}
