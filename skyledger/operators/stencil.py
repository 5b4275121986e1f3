"""Separable raster stencils as window frames.

Rasters are dense long tables ``(scene_id, r, c, ...)`` next to a table of
scene extents ``(scene_id, ny, nx)``. Each pass works along one axis and is
partitioned by scene and line, so no task holds more than a raster line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = {"c": ("r", "nx"), "r": ("c", "ny")}


def dense_raster(values: DataFrame, extents: DataFrame, cols: list[str]) -> DataFrame:
    """Every cell of each scene; absent pixels get NULL values."""
    grid = (
        extents.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1)))
        .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)))
    )
    return grid.join(values.select("scene_id", "r", "c", *cols), ["scene_id", "r", "c"], "left")


def _positions(axis: str, size: Column, h: int, edge: str) -> Column:
    """All frame positions at which a cell is seen, its mirror images included."""
    i = F.col(axis)
    if edge == "nearest":
        lo = F.when(i == 0, F.lit(-h)).otherwise(i)
        hi = F.when(i == size - 1, size - 1 + h).otherwise(i)
        return F.sequence(lo.cast("bigint"), hi.cast("bigint"))
    if edge != "reflect":
        raise ValueError(f"unknown edge rule {edge!r}")
    k = (F.floor(F.lit(h) / (2 * size)) + 1).cast("bigint")
    images = F.flatten(
        F.transform(F.sequence(-k, k), lambda n: F.array(i + 2 * size * n, -1 - i + 2 * size * n))
    )
    return F.filter(images, lambda p: (p >= -h) & (p <= size - 1 + h))


def axis_pass(
    df: DataFrame, axis: str, h: int, sums: dict[str, Column], edge: str = "reflect",
    weights: list[float] | None = None, keys: tuple[str, ...] = ("scene_id",),
) -> DataFrame:
    """Sum (or weighted sum) over ``2h+1`` neighbours along one axis, added as columns.

    ``df`` must hold every cell of the line and the extents ``ny``/``nx``.
    """
    other, size = AXES[axis]
    work = df
    for name, expr in sums.items():
        work = work.withColumn(f"_{name}", expr)
    work = work.withColumn("_pos", F.explode(_positions(axis, F.col(size), h, edge)))
    w = W.partitionBy(*keys, other).orderBy("_pos")
    if weights is None:
        frame = w.rowsBetween(-h, h)
        out = {name: F.sum(f"_{name}").over(frame) for name in sums}
    else:
        out = {}
        for name in sums:
            taps = F.collect_list(f"_{name}").over(w.rowsBetween(-h, h))
            out[name] = F.aggregate(
                F.zip_with(taps, F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b),
                F.lit(0.0),
                lambda acc, x: acc + x,
            )
    for name, expr in out.items():
        work = work.withColumn(name, expr)
    kept = work.where((F.col("_pos") >= 0) & (F.col("_pos") < F.col(size)) & (F.col("_pos") == F.col(axis)))
    return kept.drop("_pos", *[f"_{n}" for n in sums])


def box_moments(df: DataFrame, value: Column, size: int) -> DataFrame:
    """Neighbourhood count, mean and sample variance with missing cells left out.

    Adds ``n_local``, ``mean_local``, ``var_local``. Columns first, rows last.
    """
    h = size // 2
    v = value
    step = axis_pass(
        df, "c", h,
        {
            "_n": F.when(v.isNotNull(), 1.0).otherwise(0.0),
            "_s": F.coalesce(v, F.lit(0.0)),
            "_q": F.coalesce(v * v, F.lit(0.0)),
        },
    )
    both = axis_pass(step, "r", h, {"n_local": F.col("_n"), "_sum": F.col("_s"), "_sq": F.col("_q")})
    n, s, q = F.col("n_local"), F.col("_sum"), F.col("_sq")
    mean = F.when(n > 0, s / n)
    var = F.greatest((q - n * mean * mean) / F.greatest(n - 1.0, F.lit(1.0)), F.lit(0.0))
    return both.withColumn("mean_local", mean).withColumn("var_local", var).drop("_n", "_s", "_q", "_sum", "_sq")


def median_mask(df: DataFrame, mask: Column, size: int, out: str) -> DataFrame:
    """Median of a 0/1 mask: true where more than half of the square is set. Rows first."""
    h = size // 2
    a = axis_pass(df, "r", h, {"_m": mask.cast("double")})
    b = axis_pass(a, "c", h, {"_mm": F.col("_m")})
    return b.withColumn(out, F.col("_mm") >= (size * size + 1) // 2).drop("_m", "_mm")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def gaussian_smooth(df: DataFrame, value: Column, sigma: float, out: str) -> DataFrame:
    """Separable Gaussian with mirrored edges. Columns first, rows last."""
    wts = gaussian_weights(sigma)
    h = len(wts) // 2
    a = axis_pass(df, "c", h, {"_g": value.cast("double")}, weights=wts)
    b = axis_pass(a, "r", h, {out: F.col("_g")}, weights=wts)
    return b.drop("_g")


def mean_filter(df: DataFrame, value: Column, size: int, out: str) -> DataFrame:
    """Box mean with edge cells repeated and missing cells counted as zero."""
    h = size // 2
    a = axis_pass(df, "c", h, {"_f": F.coalesce(value, F.lit(0.0))}, edge="nearest")
    b = axis_pass(a, "r", h, {"_ff": F.col("_f")}, edge="nearest")
    return b.withColumn(out, F.col("_ff") / float(size * size)).drop("_f", "_ff")
