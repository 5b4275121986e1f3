"""Station observations: file scan, value parsing, daily maxima, inventory filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C

CSV_SCHEMA = "DATE STRING, TMP STRING, event_id BIGINT"


def read_station_csv(spark: SparkSession, path: str, station_pattern: str = r"station=([^/]+)/") -> DataFrame:
    """Station rows from CSV files; the station id is taken from the file path.

    Malformed rows come back as NULL fields and are dropped by the parser.
    """
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(
        F.regexp_extract("_metadata.file_path", station_pattern, 1).alias("station"),
        F.expr("try_to_timestamp(DATE)").cast("timestamp_ntz").alias("ts"),
        F.col("TMP").alias("tmp"), "event_id",
    )


def parse_temps(obs: DataFrame) -> DataFrame:
    """Rows that pass the value, quality and range screens, with ``temp_c``."""
    value = F.split_part("tmp", F.lit(","), F.lit(1))
    qc = F.trim(F.split_part("tmp", F.lit(","), F.lit(2)))
    c = F.try_cast(value, "int") if hasattr(F, "try_cast") else value.try_cast("int")
    return (
        obs.where(F.contains("tmp", F.lit(",")) & (value != C.TMP_MISSING) & qc.isin(*C.TMP_PASSING_QC) & F.col("ts").isNotNull())
        .withColumn("temp_c", c / 10.0)
        .where(F.col("temp_c").between(C.TMP_MIN_C, C.TMP_MAX_C))
        .drop("tmp")
    )


def observing_hours(ts: Column) -> Column:
    return F.hour(ts).between(C.HOUR_FIRST, C.HOUR_LAST)


def daily_max(temps: DataFrame, days: DataFrame | None = None, min_obs: int = C.MIN_OBS) -> DataFrame:
    """Daily maximum, observation count and hour of the first maximum, per station-day."""
    t = temps.withColumn("day", F.to_date("ts")).where(observing_hours(F.col("ts")))
    if days is not None:
        t = t.join(days, "day", "left_semi")
    first = F.struct((-F.col("temp_c")).alias("v"), F.col("ts"))
    return (
        t.groupBy("station", "day")
        .agg(
            F.max("temp_c").alias("tmax_c"), F.count("*").alias("n_obs"),
            F.min_by(F.hour("ts"), first).cast("bigint").alias("hour_of_max"),
        )
        .where(F.col("n_obs") >= min_obs)
    )


def screen_stations(daily: DataFrame, min_days: int = C.MIN_STATION_DAYS) -> DataFrame:
    """Valid days per station and whether it is kept."""
    return daily.groupBy("station").agg(
        F.count("*").alias("n_days"), F.max("tmax_c").alias("window_max_c")
    ).withColumn("kept", F.col("n_days") >= min_days)


def station_inventory(inventory: DataFrame, country: str, box, first: str, last: str) -> DataFrame:
    """Stations of a country with numeric position inside a box and a record over the window."""
    lat = F.col("lat").try_cast("double")
    lon = F.col("lon").try_cast("double")
    return inventory.where(
        (F.col("country") == country) & lat.between(box[1], box[3]) & lon.between(box[0], box[2])
        & (F.col("begin") <= first) & (F.col("end") >= last)
    ).withColumn("lat", lat).withColumn("lon", lon)
