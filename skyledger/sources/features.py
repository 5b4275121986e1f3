"""Vector features: collection scan and bounding-box scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTION_SCHEMA = (
    "type STRING, features ARRAY<STRUCT<type: STRING, "
    "geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties: MAP<STRING, STRING>>>"
)


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Point features of a feature-collection folder, all attributes kept as a map.

    The layer is the partition column of the folder.
    """
    raw = spark.read.schema(COLLECTION_SCHEMA + ", layer STRING").option("multiLine", True).json(path)
    f = raw.select("layer", F.explode("features").alias("f"))
    return f.select(
        "layer", F.col("f.properties").alias("attrs"), F.col("f.geometry.type").alias("geom_type"),
        F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
    )


def scan_box(features: DataFrame, box) -> DataFrame:
    """Features whose envelope meets the box; missing geometry and other reference systems drop out."""
    return features.where(
        F.col("min_lon").isNotNull() & (F.col("srs") == 4326)
        & (F.col("max_lon") >= box[0]) & (F.col("min_lon") <= box[2])
        & (F.col("max_lat") >= box[1]) & (F.col("min_lat") <= box[3])
    )
