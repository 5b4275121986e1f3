"""Result reports and artifact manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def report_json(cols: list[str]) -> Column:
    """One JSON document with its fields in alphabetical order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))


def write_reports(df: DataFrame, path: str, key: str) -> None:
    """One report folder per key value, with fields in a fixed order."""
    body = [c for c in df.columns if c != key]
    df.select(key, report_json(body).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_reports(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    raw = spark.read.schema(f"value STRING, {key} STRING").text(path)
    return raw.select(key, F.from_json("value", schema).alias("r")).select(key, "r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, SHA-256 and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("path")
