"""Surface temperature: scaling, climatology, residuals and urban contrast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def masked_lst(raw: Column, qc: Column) -> Column:
    """Kelvin from raw counts; fill and anything but the best quality is NULL."""
    return F.when((raw != 0) & (qc.bitwiseAND(3) == 0), raw * C.LST_SCALE)


def thermal_kelvin(raw: Column) -> Column:
    return raw * C.THERMAL_SCALE + C.THERMAL_OFFSET


def composite_climatology(composites: DataFrame) -> DataFrame:
    """Mean and number of years per tile, period and pixel."""
    return composites.groupBy("tile", "period", "row", "col").agg(
        F.avg("lst").alias("clim"), F.countDistinct(F.when(F.col("lst").isNotNull(), F.col("year"))).alias("n_years")
    )


def granule_anomalies(daily: DataFrame, clim: DataFrame) -> DataFrame:
    """Valid share and mean anomaly per tile-day, rounded as reported."""
    a = daily.join(clim.select("tile", "period", "row", "col", "clim"), ["tile", "period", "row", "col"])
    return a.groupBy("tile", "day").agg(
        F.bround(F.avg(F.when((F.col("lst") - F.col("clim")).isNotNull(), 1.0).otherwise(0.0)), 3).alias("valid_frac"),
        F.bround(F.avg(F.col("lst") - F.col("clim")), 2).alias("mean_anomaly"),
    )


def day_means(granules: DataFrame, pixels: int = 1200 * 1200) -> DataFrame:
    """Day means weighted by the whole number of valid pixels each granule reported."""
    n = F.floor(F.col("valid_frac") * pixels)
    g = granules.where(F.col("mean_anomaly").isNotNull())
    return g.groupBy("day").agg(
        F.bround(F.sum(F.col("mean_anomaly") * n) / F.greatest(F.sum(n), F.lit(1)), 2).alias("anomaly"),
        F.count("*").alias("n_granules"),
    )


def composite_residual(composites: DataFrame, daily: DataFrame) -> DataFrame:
    """Mean of composite minus mean-of-dailies per tile and period."""
    d = daily.groupBy("tile", "period", "row", "col").agg(F.avg("lst").alias("d"))
    return composites.join(d, ["tile", "period", "row", "col"]).groupBy("tile", "period").agg(
        F.avg(F.col("lst") - F.col("d")).alias("residual")
    ).where(F.col("residual").isNotNull())


def mean_view_time(views: DataFrame, granule: list[str], keys: list[str]) -> DataFrame:
    """Mean over granules of each granule's mean local time (not pooled)."""
    v = F.when(F.col("view_time") != C.VIEW_TIME_FILL, F.col("view_time") * C.VIEW_TIME_SCALE)
    per = views.groupBy(*keys, *granule).agg(F.avg(v).alias("_v"))
    return per.groupBy(*keys).agg(F.avg("_v").alias("view_time_h"), F.count("_v").alias("n_granules"))


def skin_consistency(granules: DataFrame, skin: DataFrame, overpass: DataFrame) -> DataFrame:
    """Satellite minus reanalysed skin temperature at the overpass hour, over the days that have both.

    ``granules``: ``day, k, n`` (mean and number of valid pixels of a granule); ``skin``: ``day,
    hour, k, lsm``, one row per cell and UTC hour; ``overpass``: one row, ``hour_utc``. A day's
    satellite value weighs granules by their pixels; the reanalysis counts land cells alone.
    """
    sat = granules.where("n > 0").groupBy("day").agg((F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("_sat"))
    land = skin.join(overpass.select(F.col("hour_utc").alias("hour")), "hour").where(F.col("lsm") > C.LAND_FRACTION)
    at_hour = land.groupBy("day", "hour").agg(F.avg("k").alias("_skin")).where(F.col("_skin").isNotNull())
    diff = F.col("_sat") - F.col("_skin")
    return sat.join(at_hour, "day").groupBy(F.col("hour").alias("hour_utc")).agg(
        F.count("*").alias("n_days"), F.avg(diff).alias("mean_diff"), F.stddev_pop(diff).alias("std_diff"))


def urban_contrast(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Urban minus rural mean per group; too few cells on either side gives NULL.

    ``cells``: ``lst, built, waterwet, dist_km`` and the parameters
    ``urban_frac, ring0, ring1``.
    """
    urban = (F.col("built") >= F.col("urban_frac")) & (F.col("dist_km") <= C.URBAN_RADIUS_KM)
    rural = (
        (F.col("built") <= C.RURAL_FRACTION) & (F.col("waterwet") < 0.5) & F.col("dist_km").between(F.col("ring0"), F.col("ring1"))
    )
    u, r = F.when(urban, F.col("lst")), F.when(rural, F.col("lst"))
    ok = (F.count(u) >= C.MIN_URBAN) & (F.count(r) >= C.MIN_RURAL)
    return cells.groupBy(*keys).agg(
        F.when(ok, F.bround(F.avg(u) - F.avg(r), 2)).alias("uhi_k"), F.count(u).alias("n_urban"), F.count(r).alias("n_rural")
    )
