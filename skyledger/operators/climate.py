"""Day-of-year climatology, heat criteria and daily exceedance records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.physics import cell_area_km2, wind_from_deg

CELL = ["region_id", "lat_i", "lon_i"]


def season_axis(years: DataFrame, start: tuple[int, int] = (1, 1), end: tuple[int, int] = (12, 31)) -> DataFrame:
    """Days of each year's season without 29 February, numbered from 0."""
    d = years.select(
        "year",
        F.explode(
            F.sequence(
                F.make_date(F.col("year").cast("int"), F.lit(start[0]), F.lit(start[1])),
                F.make_date(F.col("year").cast("int"), F.lit(end[0]), F.lit(end[1])),
            )
        ).alias("day"),
    ).where(~((F.month("day") == 2) & (F.dayofmonth("day") == 29)))
    w = W.partitionBy("year").orderBy("day")
    return d.withColumn("day_idx", (F.row_number().over(w) - 1).cast("bigint"))


def window_climatology(
    grid: DataFrame, event_year: int, variants: list[tuple[str, int, int, int]], n_days: int = 365,
    computable_only: bool = True,
) -> DataFrame:
    """Event-year values beside a pooled day-window climatology, per variant.

    ``grid`` is ``(cell keys, year, day_idx, tmax)``. A variant is
    ``(name, first_year, last_year, half_window)``. The pool is total over
    count, so unequal years weigh by their samples. One aggregate folds all
    years, a column a variant; window frames then run over at most ``n_days`` rows per cell,
    and a row per variant is made last.
    """
    is_event = F.col("year") == event_year
    among = [F.col("year").between(a, b) for _, a, b, _ in variants]
    sums = (
        grid.where(reduce(Column.__or__, among, is_event)).groupBy(*CELL, "day_idx")
        .agg(
            *[F.sum(F.when(base, F.col("tmax"))).alias(f"_s{i}") for i, base in enumerate(among)],
            *[F.count(F.when(base, F.col("tmax"))).alias(f"_n{i}") for i, base in enumerate(among)],
            F.max(F.when(is_event, F.col("tmax"))).alias("tmax"),
        )
    )
    frame = W.partitionBy(*CELL).orderBy("day_idx")
    pools = [
        F.struct(F.lit(name).alias("variant"), F.lit(h).alias("h"), F.sum(f"_s{i}").over(frame.rangeBetween(-h, h)).alias("s"),
                 F.sum(f"_n{i}").over(frame.rangeBetween(-h, h)).alias("n"))
        for i, (name, _, _, h) in enumerate(variants)
    ]
    out = (
        sums.withColumn("_pools", F.array(*pools)).where(F.col("tmax").isNotNull())
        .select(*CELL, "day_idx", "tmax", F.explode("_pools").alias("_p"))
        .withColumn("variant", F.col("_p.variant")).withColumn("h", F.col("_p.h"))
        .withColumn("clim", F.when(F.col("_p.n") > 0, F.col("_p.s") / F.col("_p.n")))
        .withColumn("clim_n", F.coalesce("_p.n", F.lit(0)).cast("bigint"))
    )
    if computable_only:
        out = out.where(F.col("day_idx").between(F.col("h"), n_days - 1 - F.col("h")))
    return out.select("variant", *CELL, "day_idx", "tmax", "clim", "clim_n")


def window_percentile(grid: DataFrame, y0: int, y1: int, h: int, p: float, n_days: int = 365) -> DataFrame:
    """Exact percentile and mean of the pooled day-window sample per cell and target day.

    The years of one cell-day are first gathered into a short array, so the
    window moves arrays instead of copying every sample to 2h+1 targets. A
    pooled sample holds at most years x (2h+1) values. Targets without any
    sample are absent.
    """
    base = grid.where(F.col("year").between(y0, y1) & F.col("tmax").isNotNull())
    days = base.groupBy(*CELL, "day_idx").agg(F.collect_list("tmax").alias("_v"))
    # Marker rows give every target day a frame, also where its own day has no sample.
    axis = days.select(*CELL).distinct().select(
        *CELL, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_days - 1).cast("bigint"))).alias("day_idx"),
        F.array().cast("array<double>").alias("_v"), F.lit(True).alias("_m"),
    )
    rows = days.withColumn("_m", F.lit(False)).unionByName(axis)
    w = W.partitionBy(*CELL).orderBy("day_idx").rangeBetween(-h, h)
    pool = rows.withColumn("_pool", F.flatten(F.collect_list("_v").over(w))).where("_m").where(F.size("_pool") > 0)
    n = F.size("_pool")
    pos = F.lit(p) * (n - 1)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    at = lambda i: F.get(F.col("_sorted"), i)
    total = F.aggregate("_pool", F.lit(0.0), lambda acc, x: acc + x)
    return pool.withColumn("_sorted", F.array_sort("_pool")).select(
        *CELL, "day_idx", (at(lo) + (at(hi) - at(lo)) * (pos - lo)).alias("pctl"), (total / n).alias("mean_pool"),
        n.cast("bigint").alias("n_pool"),
    )


def qualifies(tmax_k: Column, clim_k: Column, land: Column, abs_k: float = C.HEAT_ABS_K,
              departure_k: float = C.HEAT_DEPARTURE_K) -> Column:
    """Hot in absolute terms and anomalously hot; missing never qualifies."""
    return F.coalesce((tmax_k >= abs_k) & (tmax_k - clim_k >= departure_k) & land, F.lit(False))


def weighted_mean(v: Column, w: Column) -> Column:
    """Weighted mean that skips missing values."""
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def wind_climatology(winds: DataFrame, keys: list[str], event_year: int) -> DataFrame:
    """Area-mean wind of the event's window against the mean of the earlier years' windows.

    ``winds``: ``keys, year, day, lat, u, v``, one row per cell and day of the window. Days are
    means over cells weighted by the cosine of latitude, years means over days, the climatology
    a mean over years. Without an earlier year the climatology is NULL.
    """
    w = F.cos(F.radians("lat"))
    day = winds.groupBy(*keys, "year", "day").agg(weighted_mean(F.col("u"), w).alias("u"), weighted_mean(F.col("v"), w).alias("v"))
    year = day.groupBy(*keys, "year").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    past, now = F.col("year") < event_year, F.col("year") == event_year
    both = year.groupBy(*keys).agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in ("u", "v")], *[F.avg(F.when(past, F.col(c))).alias(f"{c}_clim") for c in ("u", "v")],
        F.count(F.when(past, 1)).alias("n_years"),
    )
    du, dv = F.col("u") - F.col("u_clim"), F.col("v") - F.col("v_clim")
    return both.where(F.col("u").isNotNull()).select(
        *keys, "n_years", F.hypot("u", "v").alias("speed"), wind_from_deg(F.col("u"), F.col("v")).alias("from_deg"),
        wind_from_deg(F.col("u_clim"), F.col("v_clim")).alias("clim_from_deg"), du.alias("du"), dv.alias("dv"), F.hypot(du, dv).alias("anomaly"),
    )


def lane_cells(clim: DataFrame, land: DataFrame, offset_k: float = C.KELVIN) -> DataFrame:
    """Cell-days of a lane with area, anomaly and the qualifying flag, land cells only."""
    return (
        clim.join(land.where(F.col("lsm") > 0.5), CELL)
        .withColumn("area", cell_area_km2(F.col("lat")))
        .withColumn("anomaly", F.col("tmax") - F.col("clim"))
        .withColumn("qualify", qualifies(F.col("tmax") + offset_k, F.col("clim") + offset_k, F.lit(True)))
    )


def lane_days(cells: DataFrame, land: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per region, variant and day: qualifying fraction, extent, mean anomaly, peak cell.

    With ``tasks`` the regions' days are dealt out to so many.
    """
    if tasks:
        cells = cells.repartition(tasks, "region_id", "variant", "day_idx")
    total = land.where(F.col("lsm") > 0.5).groupBy("region_id").agg(
        F.sum(cell_area_km2(F.col("lat"))).alias("land_area")
    )
    peak = F.struct(F.col("tmax"), (-F.col("lat_i")).alias("a"), (-F.col("lon_i")).alias("b"))
    days = cells.groupBy("region_id", "variant", "day_idx").agg(
        F.sum(F.when(F.col("qualify"), F.col("area")).otherwise(0.0)).alias("extent_km2"),
        weighted_mean(F.col("anomaly"), F.col("area")).alias("mean_anomaly"),
        F.max("anomaly").alias("peak_anomaly"),
        F.max("tmax").alias("peak_tmax"),
        F.max_by(F.struct("lat_i", "lon_i", "lat", "lon"), peak).alias("peak_cell"),
    )
    return days.join(total, "region_id").withColumn("area_frac", F.col("extent_km2") / F.col("land_area"))


def exceedance_records(cells: DataFrame, land: DataFrame, ref: Column, clim: Column, flag: Column) -> DataFrame:
    """Daily record over flagged land cells: fraction, severity, centroid and peak cell.

    ``cells`` has ``family`` and cell-days with ``lat``/``lon``; weights are
    cos(latitude); the centroid is taken in index space.
    """
    w = F.cos(F.radians("lat"))
    wf = F.when(flag, w)
    total = land.where(F.col("lsm") > 0.5).groupBy("region_id").agg(F.sum(F.cos(F.radians("lat"))).alias("_w"))
    order = F.struct((F.col("tmax") - clim).alias("a"), (-F.col("lat_i")).alias("b"), (-F.col("lon_i")).alias("c"))
    g = cells.groupBy("region_id", "family", "year", "day_idx").agg(
        F.coalesce(F.sum(wf), F.lit(0.0)).alias("_wf"),
        F.sum((F.col("tmax") - ref) * wf).alias("_sev"),
        F.sum(F.col("lat_i") * wf).alias("_ci"), F.sum(F.col("lon_i") * wf).alias("_cj"),
        F.max(F.when(flag, F.col("tmax") - clim)).alias("_peak"),
        F.max_by(F.when(flag, F.struct("lat", "lon")), F.when(flag, order)).alias("peak_cell"),
    )
    some = F.col("_wf") > 0
    return g.join(total, "region_id").select(
        "region_id", "family", "year", "day_idx",
        (F.col("_wf") / F.col("_w")).alias("area_frac"),
        F.when(some, F.col("_sev") / F.col("_wf")).otherwise(0.0).alias("severity"),
        F.when(some, F.col("_peak")).otherwise(0.0).alias("peak_anomaly"),
        F.when(some, F.col("_ci") / F.col("_wf")).alias("centroid_i"),
        F.when(some, F.col("_cj") / F.col("_wf")).alias("centroid_j"),
        "peak_cell",
    )
