"""Raster alignment: lookup gathers, pairing, affine sampling and regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orthorectify(raw: DataFrame, glt: DataFrame, extents: DataFrame) -> DataFrame:
    """Gather raw pixels per ortho cell through a 1-based lookup.

    A zero in either index means no source (NULL); other indices clip to the
    raw raster. ``extents`` gives ``n_lines`` and ``n_cols`` per scene.
    """
    g = glt.join(extents, "scene_id").select(
        "scene_id", "oy", "ox",
        F.when(
            (F.col("glt_y") != 0) & (F.col("glt_x") != 0),
            F.greatest(F.least("glt_y", "n_lines") - 1, F.lit(0)).cast("bigint"),
        ).alias("line"),
        F.when(
            (F.col("glt_y") != 0) & (F.col("glt_x") != 0),
            F.greatest(F.least("glt_x", "n_cols") - 1, F.lit(0)).cast("bigint"),
        ).alias("xtrack"),
    )
    return g.join(raw, ["scene_id", "line", "xtrack"], "left").select("scene_id", "oy", "ox", "value")


def pair_rasters(own: DataFrame, ref: DataFrame) -> DataFrame:
    """Pixel-aligned pairs ``(scene_id, r, c, own, ref)`` with a status per scene.

    Scenes of different shape are ``grid mismatch``. A scene of one product only keeps
    its pixels, with NULL on the other side, as ``no own scene`` or ``no reference scene``.
    """
    ext = lambda d, p: d.groupBy("scene_id").agg(
        F.max("r").alias(f"{p}_r"), F.max("c").alias(f"{p}_c")
    )
    shape = ext(own, "o").join(ext(ref, "f"), "scene_id", "full_outer").select(
        "scene_id",
        F.when(F.col("o_r").isNull(), "no own scene").when(F.col("f_r").isNull(), "no reference scene")
        .when((F.col("o_r") == F.col("f_r")) & (F.col("o_c") == F.col("f_c")), "ok")
        .otherwise("grid mismatch").alias("status"),
    )
    pairs = own.withColumnRenamed("value", "own").withColumn("_o", F.lit(True)).join(
        ref.withColumnRenamed("value", "ref").withColumn("_f", F.lit(True)), ["scene_id", "r", "c"], "full_outer"
    )
    kept = (F.col("_o") & F.col("_f")) | F.col("status").startswith("no ")
    return pairs.join(shape, "scene_id").where(kept).drop("_o", "_f")


def affine_sample(points: DataFrame, raster: DataFrame, affine: DataFrame) -> DataFrame:
    """Raster value at each point by inverse affine and half-even rounding; NULL outside."""
    p = points.join(affine, "scene_id").withColumn(
        "c", F.bround((F.col("lon") - F.col("x0")) / F.col("dx")).cast("bigint")
    ).withColumn("r", F.bround((F.col("lat") - F.col("y0")) / F.col("dy")).cast("bigint"))
    return p.join(raster, ["scene_id", "r", "c"], "left")


def nearest_index(coord: Column, origin: Column | float, step: Column | float) -> Column:
    """Index of the nearest regular-grid coordinate; a tie goes to the lower index."""
    return F.ceil((coord - F.lit(origin)) / F.lit(step) - 0.5).cast("bigint")


def coarse_index(coord: Column, origin: float, step: float) -> Column:
    """Index of the coarse cell ``[centre - step/2, centre + step/2)`` that holds ``coord``."""
    return F.floor((coord - F.lit(origin) + F.lit(step / 2)) / F.lit(step)).cast("bigint")


def coarsen(
    fine: DataFrame, keys: list[str], lat: Column, lon: Column, value: Column,
    origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int],
) -> DataFrame:
    """Mean of the fine cells inside each coarse cell; all-missing stays missing."""
    cells = fine.select(
        *keys, coarse_index(lat, origin[0], step[0]).alias("ci"),
        coarse_index(lon, origin[1], step[1]).alias("cj"), value.alias("_v"),
    ).where(F.col("ci").between(0, shape[0] - 1) & F.col("cj").between(0, shape[1] - 1))
    return cells.groupBy(*keys, "ci", "cj").agg(F.avg("_v").alias("value"))


def class_fractions(cells: DataFrame, keys: list[str], cls: Column, groups: dict[str, list[int]]) -> DataFrame:
    """Share of fine cells per class group in each coarse cell."""
    return cells.groupBy(*keys).agg(
        *[F.avg(cls.isin(*codes).cast("double")).alias(name) for name, codes in groups.items()]
    )
