"""Binary daily grids and text spectra."""

from __future__ import annotations

import calendar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C

# 31 x 31 one-degree cells from 7.5 N, 67.5 E.
NX = NY = 31
LAT0, LON0 = 7.5, 67.5
_OUT = "path string, year int, day date, lat double, lon double, tmax double"


def _decoder(drop_missing: bool):
    def decode(batches):
        lat = np.repeat(LAT0 + np.arange(NY), NX)
        lon = np.tile(LON0 + np.arange(NX), NY)
        for pdf in batches:
            for rec in pdf.itertuples(index=False):
                days = 366 if calendar.isleap(rec.year) else 365
                if len(rec.content) != days * NY * NX * 4:
                    raise ValueError(f"{rec.path}: {len(rec.content) // 4} floats, expected {days * NY * NX}")
                cube = np.frombuffer(rec.content, dtype="<f4").astype(float).reshape(days, NY * NX)
                gone = np.abs(cube - C.GRID_MISSING) <= 0.05 + 1e-5 * C.GRID_MISSING
                first = np.datetime64(f"{rec.year}-01-01")
                for start in range(0, days, 61):
                    part, miss = cube[start : start + 61], gone[start : start + 61]
                    d, k = np.nonzero(~miss) if drop_missing else np.indices(part.shape).reshape(2, -1)
                    if not len(d):
                        continue
                    yield pd.DataFrame({
                        "path": rec.path, "year": rec.year, "day": (first + start + d).astype("datetime64[s]"),
                        "lat": lat[k], "lon": lon[k], "tmax": pd.arrays.FloatingArray(part[d, k], miss[d, k]),
                    })

    return decode


def decode_daily_grid(files: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Rows of day-major little-endian float32 files ``(path, year, content)``.

    A file of the wrong size is an error; the missing code becomes NULL, or no
    row at all with ``drop_missing``.
    """
    return files.select("path", F.col("year").cast("int").alias("year"), "content").mapInPandas(_decoder(drop_missing), _OUT)


def read_daily_grid(
    spark: SparkSession, path: str, year_pattern: str = r"(\d{4})[^/]*$", drop_missing: bool = False
) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return decode_daily_grid(
        files.select("path", F.regexp_extract("path", year_pattern, 1).cast("int").alias("year"), "content"), drop_missing
    )


def parse_spectrum(lines: DataFrame) -> DataFrame:
    """Index, wavelength and value from whitespace-separated text; fewer than three fields is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    ok = F.size(parts) >= 3
    pick = lambda i, t: F.when(ok, F.get(parts, F.lit(i))).otherwise(
        F.raise_error(F.concat(F.lit("spectrum line needs 3 columns: "), F.col("value"))).cast("string")
    ).cast(t)
    keep = [c for c in lines.columns if c != "value"]
    return lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).select(
        *keep, pick(0, "double").cast("bigint").alias("idx"), pick(1, "double").alias("wl"), pick(2, "double").alias("k")
    )


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return parse_spectrum(text.select("value", F.col("_metadata.file_path").alias("path")))
