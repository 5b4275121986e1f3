"""Plume segmentation, mass, rate and agreement statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import physics as P
from ..functions.numeric import t_upper_tail
from ..session import materialise
from . import stencil
from .asof import bracket_interpolate
from .components import label_regions
from .percentiles import exact_percentiles


def background(raster: DataFrame, is_background: Column, min_n: int = C.NEIGHBOURHOOD**2) -> DataFrame:
    """Mean, sample variance and size of the off-plume pixels per scene; too few gives a status."""
    v = F.when(is_background, F.col("value"))
    return raster.groupBy("scene_id").agg(
        F.avg(v).alias("bg_mean"), F.var_samp(v).alias("bg_var"), F.count(v).alias("bg_n"),
        F.when(F.count(v) >= min_n, "ok").otherwise("background too small").alias("status"),
    )


def welch(n: Column, mean: Column, var: Column, bg_n: Column, bg_mean: Column, bg_var: Column) -> tuple[Column, Column]:
    """Welch statistic of a neighbourhood against the background and its degrees of freedom."""
    one = F.lit(1.0)
    a = F.when(n > 0, var / F.greatest(n, one))
    b = bg_var / bg_n
    t = (mean - bg_mean) / F.sqrt(a + b)
    den = a * a / F.greatest(n - 1.0, one) + b * b / F.greatest(bg_n - 1.0, one)
    return t, F.when(den > 0, (a + b) * (a + b) / den)


def tested(dense: DataFrame, bg: DataFrame) -> DataFrame:
    """Every pixel with the one-sided p-value of its 5x5 neighbourhood against the background."""
    local = stencil.box_moments(dense, F.col("value"), C.NEIGHBOURHOOD).join(bg, "scene_id")
    t, df = welch(*[F.col(c) for c in ("n_local", "mean_local", "var_local", "bg_n", "bg_mean", "bg_var")])
    return local.withColumn("t_stat", t).withColumn("df", df).withColumn("p", t_upper_tail("t_stat", "df"))


def _significant(p_value: Column) -> Column:
    hit = (F.col("p") < p_value) & (F.col("n_local") >= C.NEIGHBOURHOOD**2 / 2) & F.col("value").isNotNull()
    return F.coalesce(hit & (F.col("status") == "ok"), F.lit(False))


def candidates(dense: DataFrame, bg: DataFrame, p_value: float = C.T_TEST_P) -> DataFrame:
    """Pixels whose 5x5 neighbourhood is significantly above background."""
    return tested(dense, bg).withColumn("candidate", _significant(F.lit(p_value)))


def smooth_mask(cand: DataFrame) -> DataFrame:
    """Median then Gaussian smoothing of the candidate mask, thresholded to ``plume``."""
    med = stencil.median_mask(cand, F.col("candidate"), C.MEDIAN_SIZE, "majority")
    smooth = stencil.gaussian_smooth(med, F.col("majority"), C.GAUSS_SIGMA, "smoothed")
    return smooth.withColumn("plume", F.col("smoothed") > C.SMOOTHED_THRESHOLD)


def segment(dense: DataFrame, is_background: Column, p_value: float = C.T_TEST_P) -> DataFrame:
    """Labelled plume cells ``(scene_id, r, c, label)`` of every scene.

    ``dense`` holds every cell of each scene with ``value`` and extents.
    """
    bg = background(dense, is_background)
    mask = smooth_mask(candidates(dense, bg, p_value)).where("plume")
    return label_regions(mask, reach=1)


def quantify(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mass, area, length and rate per group of mask cells.

    ``cells`` carries ``enh``, ``area_m2`` and the group-constant ``n_air``,
    ``u10`` and ``u10_sigma``. Missing pixels add area but no mass.
    """
    mass = F.col("enh") * 1.0e-6 * C.CH4_KG_PER_MOL * F.col("area_m2")
    g = cells.groupBy(*keys).agg(
        F.count("*").alias("n_px"),
        F.coalesce(F.sum(mass), F.lit(0.0)).alias("_mass"),
        F.sum("area_m2").alias("area_m2"),
        F.max("n_air").alias("n_air"), F.max("u10").alias("u10"), F.max("u10_sigma").alias("u10_sigma"),
    )
    w = P.wind_sigma(F.col("u10"), F.col("u10_sigma"))
    return (
        g.withColumn("ime_kg", F.col("_mass") * F.col("n_air"))
        .withColumn("length_m", F.sqrt("area_m2"))
        .withColumn("u_eff", P.u_eff(F.col("u10")))
        .withColumn("q_kg_s", P.q_kg_s(F.col("ime_kg"), F.col("u_eff"), F.col("length_m")))
        .withColumn("q_t_h", F.col("q_kg_s") * C.KG_S_TO_T_H)
        .withColumn("wind", w)
        .withColumn("status", F.when(F.col("length_m") > 0, "ok").otherwise("zero area"))
        .drop("_mass")
    )


def guarded_corr(a: Column, b: Column, cond: Column, more_than: int) -> Column:
    """Pearson correlation over pairs that satisfy ``cond``; NULL unless enough pairs."""
    both = cond & a.isNotNull() & b.isNotNull()
    return F.when(F.count(F.when(both, 1)) > more_than, F.corr(F.when(both, a), F.when(both, b)))


def agreement(pairs: DataFrame, inside: Column) -> DataFrame:
    """Correlation with the reference over the scene, a box, and strong pixels of the box."""
    a, b = F.col("own"), F.col("ref")
    strong = inside & ((a > C.STRONG_PPM_M) | (b > C.STRONG_PPM_M))
    finite = a.isNotNull() & b.isNotNull()
    return pairs.groupBy("scene_id").agg(
        guarded_corr(a, b, F.lit(True), 0).alias("pearson_full"),
        guarded_corr(a, b, inside, 0).alias("pearson_box"),
        guarded_corr(a, b, strong, 50).alias("pearson_strong"),
        F.count(F.when(finite, 1)).alias("n_full"),
        F.count(F.when(finite & inside, 1)).alias("n_box"),
    )


def amplitude_bias(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of own to reference over a mask, by means and by integrated mass."""
    both = F.col("own").isNotNull() & F.col("ref").isNotNull()
    return cells.groupBy(*keys).agg(
        (F.avg(F.when(F.col("ref").isNotNull(), F.col("own"))) /
         F.avg(F.when(F.col("ref").isNotNull(), F.col("ref")))).alias("bias_mean"),
        (F.sum(F.when(both, F.col("own") * F.col("area_m2"))) /
         F.sum(F.when(both, F.col("ref") * F.col("area_m2")))).alias("bias_ime"),
    )


def upwind_source(cells: DataFrame, wind: DataFrame) -> DataFrame:
    """Mean position of the most upwind twentieth of a mask, per scene.

    ``cells`` has ``scene_id, lon, lat``; ``wind`` has ``scene_id, u, v``.
    """
    centre = cells.groupBy("scene_id").agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    mag = F.hypot(F.col("u"), F.col("v"))
    x = (F.col("lon") - F.col("clon")) * C.PLANAR_METERS_PER_DEGREE * F.cos(F.radians("clat"))
    y = (F.col("lat") - F.col("clat")) * C.PLANAR_METERS_PER_DEGREE
    proj = cells.join(centre, "scene_id").join(wind, "scene_id").withColumn(
        "proj", (x * -F.col("u") + y * -F.col("v")) / mag
    )
    cut = exact_percentiles(proj, ["scene_id"], F.col("proj"), {"cut": 1.0 - C.TOP_FRACTION})
    top = (
        proj.join(cut.select("scene_id", "cut"), "scene_id").where(F.col("proj") >= F.col("cut") - C.PROJECTION_TIE_M)
        .groupBy("scene_id", "clon", "clat")
        .agg(F.avg("lon").alias("source_lon"), F.avg("lat").alias("source_lat"), F.count("*").alias("n_top"))
    )
    dx = (F.col("source_lon") - F.col("clon")) * C.PLANAR_METERS_PER_DEGREE * F.cos(F.radians("clat"))
    dy = (F.col("source_lat") - F.col("clat")) * C.PLANAR_METERS_PER_DEGREE
    return top.withColumn("dist_km", F.hypot(dx, dy) / 1000.0)


def source_wind_check(cells: DataFrame, when: DataFrame, samples: DataFrame, keys: list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rate with the wind at the plume's source against the rate with the wind at its centroid.

    ``cells``: mask cells with ``scene_id, lon, lat, enh, area_m2, n_air``; ``when``: ``scene_id, t``
    (epoch seconds); ``samples``: ``keys, ts, u, v``; ``place`` adds the sample grid's ``keys`` to rows
    of ``scene_id, lon, lat``. The wind is interpolated at the centroid; it points to the source,
    where it is interpolated once more. One row per scene of ``cells``; ``status`` tells where no
    sample was near in time or the wind stood still, and the values that need it are NULL.
    """

    def wind_at(points: DataFrame) -> DataFrame:
        asked = place(points).join(when, "scene_id").select(*keys, F.col("scene_id").alias("request_id"), "t")
        found = bracket_interpolate(asked, samples, keys, ["u", "v"])
        speed = F.hypot("u", "v")
        return materialise(found.where((F.col("status") == "ok") & (speed > 0)).select(
            F.col("request_id").alias("scene_id"), "u", "v", speed.alias("u10"), P.u10_sample_sigma(F.col("hour_distance")).alias("u10_sigma")
        ), "wind-at")

    mask = cells.select("scene_id", "lon", "lat", "enh", "area_m2", "n_air")
    first = wind_at(mask.groupBy("scene_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))
    source = materialise(upwind_source(mask.select("scene_id", "lon", "lat"), first.select("scene_id", "u", "v")), "source")
    second = wind_at(source.select("scene_id", F.col("source_lon").alias("lon"), F.col("source_lat").alias("lat")))

    def rate(wind: DataFrame, end: str) -> DataFrame:
        q = quantify(mask.join(wind.select("scene_id", "u10", "u10_sigma"), "scene_id"), ["scene_id"])
        return q.select("scene_id", F.col("u10").alias(f"u10_{end}"), F.col("q_t_h").alias(f"q_{end}"))

    out = mask.select("scene_id").distinct().join(rate(first, "centroid"), "scene_id", "left").join(rate(second, "source"), "scene_id", "left")
    out = out.join(source.select("scene_id", "source_lon", "source_lat", "dist_km"), "scene_id", "left")
    rel = F.abs(F.col("q_source") - F.col("q_centroid")) / F.when(F.col("q_centroid") != 0, F.abs("q_centroid"))
    status = F.when(F.col("q_centroid").isNull(), "no wind at centroid").when(F.col("q_source").isNull(), "no wind at source").otherwise("ok")
    return out.select("*", (F.col("u10_source") - F.col("u10_centroid")).alias("delta_u10"), rel.alias("rel_delta"),
                      (rel >= C.MATERIAL_DELTA_Q).alias("material"), status.alias("status"))


def p_value_sweep(dense: DataFrame, is_background: Column, facts: DataFrame, p_values: tuple[float, ...] = C.SEG_P_VALUES,
                  central: float = C.T_TEST_P, min_px: int = 10) -> DataFrame:
    """The plume's rate for every significance level: ``scene_id, p_value, n_px, q_t_h, spread``.

    ``facts``: ``scene_id, r, c, inside`` and what :func:`quantify` needs. The p-values are computed
    once; all levels then pass the smoothing and the labelling together, as variants of each scene. The
    plume of a level is its largest region by cells inside the box (ties: lowest label). Masks
    below ``min_px`` pixels have no rate; ``spread`` is (max - min) / the central rate over the
    others, 0 with fewer than two of them or without a central rate above 0. Every scene of
    ``dense`` has a row for every level.
    """
    pixels = materialise(tested(dense, background(dense, is_background)), "p-values")
    levels = F.array(*map(F.lit, p_values))
    variants = pixels.select("*", F.posexplode(levels).alias("_i", "_level")).withColumn("candidate", _significant(F.col("_level")))
    # A variant of a scene is a scene of its own to the stencils and the labelling: "<level>:<scene>".
    kind = dense.schema["scene_id"].dataType
    variants = variants.withColumn("scene_id", F.concat_ws(":", "_i", F.col("scene_id").cast("string")))
    labels = label_regions(smooth_mask(variants).where("plume"), reach=1)
    level = F.get(levels, F.substring_index("scene_id", ":", 1).cast("int"))
    scene = F.regexp_replace("scene_id", "^[0-9]+:", "").cast(kind)
    cells = labels.select(scene.alias("scene_id"), level.alias("p_value"), "r", "c", "label").join(facts, ["scene_id", "r", "c"])
    cells = materialise(cells, "sweep-cells")
    keys = ["scene_id", "p_value"]
    inside = cells.where("inside").groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    best = inside.groupBy(*keys).agg(F.max_by("label", F.struct(F.col("_n"), -F.col("label"))).alias("label"))
    rates = quantify(cells.join(best, [*keys, "label"]), keys).select(*keys, "n_px", F.when(F.col("n_px") >= min_px, F.col("q_t_h")).alias("q_t_h"))
    every = pixels.select("scene_id").distinct().select("scene_id", F.explode(levels).alias("p_value"))
    out = every.join(rates, keys, "left").withColumn("n_px", F.coalesce("n_px", F.lit(0)))
    w = W.partitionBy("scene_id")
    middle = F.max(F.when(F.col("p_value") == central, F.col("q_t_h"))).over(w)
    wide = F.when((F.count("q_t_h").over(w) >= 2) & (middle > 0), (F.max("q_t_h").over(w) - F.min("q_t_h").over(w)) / middle)
    return out.select(*keys, "n_px", "q_t_h", F.coalesce(wide, F.lit(0.0)).alias("spread"))


def sweep_spread(rates: DataFrame, keys: list[str], q: str, n_px: str, min_px: int, central: DataFrame) -> DataFrame:
    """Relative spread of the rate over a parameter sweep; small masks are left out."""
    usable = F.when(F.col(n_px) >= min_px, F.col(q))
    s = rates.groupBy(*keys).agg(
        F.max(usable).alias("_hi"), F.min(usable).alias("_lo"), F.count(usable).alias("n_used")
    )
    return s.join(central, keys).select(
        *keys, "n_used",
        F.when((F.col("n_used") >= 2) & (F.col("q_t_h") > 0), (F.col("_hi") - F.col("_lo")) / F.col("q_t_h"))
        .otherwise(F.lit(0.0)).alias("spread"),
    )


def rate_bounds(q: Column, q_cal: Column, wind_total: Column, spread: Column) -> Column:
    """Combined fractional sigma and the asymmetric interval around the calibrated rate."""
    s = F.sqrt(wind_total * wind_total + (spread / 2) * (spread / 2))
    return F.struct(s.alias("sigma"), (q_cal * (1 - s)).alias("low"), (q * (1 + s)).alias("high"))


def self_isolation(seg: DataFrame) -> DataFrame:
    """Does a segmented region cover the reference footprint? ``seg`` has one row per region cell."""
    g = seg.groupBy("scene_id", "label").agg(
        F.count("*").alias("n_px"),
        F.count(F.when(F.col("in_footprint"), 1)).alias("n_overlap"),
        F.avg("ref").alias("ref_mean"),
    )
    return g.withColumn(
        "isolated",
        F.coalesce(
            (F.col("label") != 0) & (F.col("n_overlap") >= 0.3 * F.col("n_px")) & (F.col("ref_mean") > 0), F.lit(False)
        ),
    )
