"""From radiance to rate for every scene in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import physics as P
from ..operators import asof, plume, raster, spectral
from ..session import materialise


def enhancement_maps(pixels: DataFrame, bands: DataFrame, glt: DataFrame, raw_extents: DataFrame, alpha=C.SHRINKAGE,
                     scale: float = C.PPM_SCALE) -> DataFrame:
    """Matched-filter enhancement on the ortho grid: ``scene_id, r, c, value``."""
    enh = spectral.matched_filter(pixels, bands, alpha=alpha, scale=scale)
    raw = enh.select("scene_id", "line", "xtrack", F.col("enh").alias("value"))
    ortho = raster.orthorectify(raw, glt, raw_extents)
    return ortho.select("scene_id", F.col("oy").alias("r"), F.col("ox").alias("c"), "value")


def quantify_scenes(own: DataFrame, ref: DataFrame, affine: DataFrame, boxes: DataFrame, state: DataFrame, weather: DataFrame,
                    thresholds: list[float], central: float) -> dict[str, DataFrame]:
    """Agreement, rate, source point and uncertainty of each scene's plume.

    ``own``/``ref``: ``scene_id, r, c, value``; ``affine``: cell-centre origin
    and step; ``boxes``: plume box per scene; ``state``: ``scene_id, t`` and the
    pressure and temperature; ``weather``: hourly ``cell_i, cell_j, ts, u, v``
    on a quarter-degree grid with origin ``glat0, glon0``.
    """
    pairs = raster.pair_rasters(own, ref).join(affine, "scene_id").join(boxes, "scene_id").join(
        state.select("scene_id", P.n_air(F.col("pressure"), F.col("temperature")).alias("n_air")), "scene_id")
    lon, lat = F.col("lon0") + F.col("c") * F.col("dlon"), F.col("lat0") + F.col("r") * F.col("dlat")
    pairs = pairs.withColumn("lon", lon).withColumn("lat", lat)
    inside = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    pairs = pairs.withColumn("inside", inside).withColumn("area_m2", P.pixel_area_m2(F.col("lat"), F.abs("dlon"), F.abs("dlat")))
    foot = materialise(
        pairs.where(F.col("inside") & F.col("own").isNotNull())
        .withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in sorted({*thresholds, central})])))
        .where(F.col("ref") > F.col("thr"))
        .select("scene_id", "thr", "own", "ref", "lon", "lat", "area_m2", "n_air", F.col("own").alias("enh")), "footprints")
    core = foot.where(F.col("thr") == central)
    centre = core.groupBy("scene_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    wind = materialise(_wind_at(centre, state, weather), "wind")
    u10 = wind.select("scene_id", F.hypot("u", "v").alias("u10"), P.u10_sample_sigma(F.col("hour_distance")).alias("u10_sigma"))
    rates = plume.quantify(foot.join(u10, "scene_id"), ["scene_id", "thr"])
    source = plume.upwind_source(core.select("scene_id", "lon", "lat"), wind.select("scene_id", "u", "v"))
    moved = _wind_at(source.select("scene_id", F.col("source_lon").alias("lon"), F.col("source_lat").alias("lat")), state, weather)
    at_source = plume.quantify(
        core.join(moved.select("scene_id", F.hypot("u", "v").alias("u10"), P.u10_sample_sigma(F.col("hour_distance")).alias("u10_sigma")), "scene_id"),
        ["scene_id"]).select("scene_id", F.col("q_t_h").alias("q_source"))
    main = rates.where(F.col("thr") == central).drop("thr")
    spread = plume.sweep_spread(rates.select("scene_id", F.col("q_t_h").alias("q"), "n_px"), ["scene_id"], "q", "n_px", 5,
                                main.select("scene_id", "q_t_h"))
    bias = plume.amplitude_bias(core, ["scene_id"])
    q = main.join(bias, "scene_id").join(spread, "scene_id").join(at_source, "scene_id", "left").withColumn(
        "q_cal", F.col("q_t_h") / F.col("bias_ime"))
    q = q.withColumn("bounds", plume.rate_bounds(F.col("q_t_h"), F.col("q_cal"), F.col("wind.total"), F.col("spread"))).withColumn(
        "regime", P.wind_regime(F.col("u10"))).withColumn("rel_delta_source", F.abs(F.col("q_source") - F.col("q_t_h")) / F.col("q_t_h"))
    return {"agreement": plume.agreement(pairs, F.col("inside")), "rates": rates, "estimate": q, "source": source}


def _wind_at(points: DataFrame, state: DataFrame, weather: DataFrame) -> DataFrame:
    """Wind at a point per scene at its overpass time, from the nearest quarter-degree cell; without a sample, NULL and a status."""
    j = points.join(state.select("scene_id", "t", "glat0", "glon0"), "scene_id")
    j = j.withColumn("cell_i", raster.nearest_index(F.col("lat"), F.col("glat0"), 0.25)).withColumn(
        "cell_j", raster.nearest_index(F.col("lon"), F.col("glon0"), 0.25)).withColumn("request_id", F.col("scene_id"))
    return asof.bracket_interpolate(j, weather, ["cell_i", "cell_j"], ["u", "v"])
