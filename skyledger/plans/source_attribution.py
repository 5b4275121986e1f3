"""Rank possible sources upwind of each plume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import attribution, spatial
from ..session import materialise


def attribute_sources(plumes: DataFrame, features: DataFrame, fields: DataFrame, radius_km: float, cell_deg: float = 0.25) -> dict[str, DataFrame]:
    """Facility and field hypotheses for every plume.

    ``plumes``: ``event_id, apex_lon, apex_lat, u, v, sigma, u_eff, length_m``;
    ``features``: ``layer, feature_id, lon, lat, name, operator``; ``fields``:
    ``poly_id, rings``.
    """
    g = geo.wedge(F.col("u"), F.col("v"), F.hypot("u", "v"), F.col("sigma"), F.col("u_eff"), F.col("length_m"))
    wedges = plumes.select("event_id", "apex_lon", "apex_lat", g.alias("g")).select(
        "event_id", "apex_lon", "apex_lat", "g.*", F.lit(float(radius_km)).alias("radius_km"))
    pairs = materialise(spatial.relate_to_wedges(features, wedges, cell_deg, only_2s=True), "wedge-pairs")
    ranked = materialise(spatial.rank_candidates(pairs), "ranked")
    summary = attribution.facility_summary(ranked)
    apex = plumes.select(F.col("event_id").alias("point_id"), F.col("apex_lon").alias("lon"), F.col("apex_lat").alias("lat"))
    inside = spatial.points_in_polygons(apex, fields).select(F.col("point_id").alias("event_id")).distinct()
    contained = plumes.select("event_id").join(inside.withColumn("_h", F.lit(True)), "event_id", "left").select(
        "event_id", F.coalesce("_h", F.lit(False)).alias("contained"))
    return {
        "ranked": ranked,
        "summary": summary,
        "alternatives": attribution.alternatives(ranked, summary),
        "facility": attribution.facility_hypotheses(summary),
        "field": attribution.field_hypotheses(contained),
    }
