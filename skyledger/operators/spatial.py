"""Wedges, polygons and candidate ranking over point features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo
from ..functions.numeric import geodesic
from ..session import materialise
from .percentiles import exact_row_number


#: Points of one cell and salt at most, and how often a base cell may be halved.
CELL_ROWS, DEPTH = 4096, 8


def cell_tree(points: DataFrame, cell_deg: float, wrap: bool, rows: int = CELL_ROWS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Points dealt to cells split by their own counts, and those cells: a quadtree from one aggregate.

    A cell of ``cell_deg`` with more than ``rows`` points is replaced by its quarters, and so on
    ``depth`` times; a smallest cell that still holds more is shared out over salts. Returns
    ``points`` with ``_level, _i, _j, _salt`` and the cells ``_level, _i, _j, _salts``.
    ``wrap`` counts longitudes from 0 to 360.
    """
    fine = cell_deg / (1 << depth)
    lon = F.pmod("lon", F.lit(360.0)) if wrap else F.col("lon")
    placed = points.withColumn("_fi", F.floor(F.col("lat") / fine).cast("bigint")).withColumn("_fj", F.floor(lon / fine).cast("bigint"))

    def above(c: str, level: Column) -> Column:
        return F.call_function("shiftright", F.col(c), F.lit(depth) - level)

    cells = materialise(placed.groupBy("_fi", "_fj").agg(F.count("*").alias("_n")), "cells")
    levels = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    levels = levels.select("_fi", "_fj", "_n", "_level", above("_fi", F.col("_level")).alias("_i"), above("_fj", F.col("_level")).alias("_j"))
    crowded = levels.groupBy("_level", "_i", "_j").agg(F.sum("_n").alias("_m")).where(F.col("_m") > rows).drop("_m")
    split = levels.join(crowded, ["_level", "_i", "_j"]).groupBy("_fi", "_fj").agg(F.count("*").cast("int").alias("_level"))
    leaf = cells.join(split, ["_fi", "_fj"], "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    leaf = leaf.select("_fi", "_fj", "_n", "_level", above("_fi", F.col("_level")).alias("_i"), above("_fj", F.col("_level")).alias("_j"))
    leaf = materialise(leaf, "leaf-cells")
    leaves = leaf.groupBy("_level", "_i", "_j").agg(F.ceil(F.sum("_n") / rows).cast("int").alias("_salts"))
    leaves = materialise(leaves, "leaves")
    dealt = placed.join(leaf.drop("_n").join(leaves, ["_level", "_i", "_j"]), ["_fi", "_fj"])
    # A hash of the row, so that a repeated task deals it alike.
    whole = [f.name for f in points.schema if f.dataType.typeName() not in ("map", "variant")]
    salt = F.pmod(F.xxhash64(*whole), F.col("_salts")).cast("int")
    return dealt.withColumn("_salt", salt).drop("_fi", "_fj", "_salts"), leaves


def boxes_on_cells(boxes: DataFrame, leaves: DataFrame, cell_deg: float, wrap: bool) -> DataFrame:
    """``boxes`` (``_w, _s, _e, _n``, degrees) once for every cell of :func:`cell_tree` they touch.

    Added: the cell, ``_salts`` and its bounds ``_cw, _cs, _ce, _cn``. Boxes meet cells on the base
    grid; a box wider than the globe touches every cell between its latitudes.
    """
    around = int(round(360 / cell_deg))
    row, col = (F.floor(F.col(c) / cell_deg).cast("bigint") for c in ("_s", "_w"))
    last = F.floor(F.col("_e") / cell_deg).cast("bigint")
    cols = F.sequence(col, F.least(last, col + around - 1) if wrap else last)
    b = boxes.withColumn("_bi", F.explode(F.sequence(row, F.floor(F.col("_n") / cell_deg).cast("bigint")))).withColumn("_bj", F.explode(cols))
    if wrap:
        b = b.withColumn("_bj", F.pmod("_bj", F.lit(around)))
    size = F.lit(cell_deg) / F.call_function("shiftleft", F.lit(1), F.col("_level"))
    c = leaves.select(
        "*", F.call_function("shiftright", F.col("_i"), F.col("_level")).alias("_bi"), F.call_function("shiftright", F.col("_j"), F.col("_level")).alias("_bj"),
        (F.col("_i") * size).alias("_cs"), ((F.col("_i") + 1) * size).alias("_cn"), (F.col("_j") * size).alias("_cw"), ((F.col("_j") + 1) * size).alias("_ce"),
    )
    met = b.join(c, ["_bi", "_bj"]).where((F.col("_cs") <= F.col("_n")) & (F.col("_cn") >= F.col("_s")))
    if wrap:
        between = F.abs(F.pmod((F.col("_cw") + F.col("_ce") - F.col("_w") - F.col("_e")) / 2 + 180, F.lit(360.0)) - 180)
        met = met.where(between <= (F.col("_ce") - F.col("_cw") + F.col("_e") - F.col("_w")) / 2)
    else:
        met = met.where((F.col("_cw") <= F.col("_e")) & (F.col("_ce") >= F.col("_w")))
    return met.drop("_bi", "_bj")


def _on_sphere(lon1: str, lat1: str, lon2: str, lat2: str) -> tuple[Column, Column]:
    """Kilometres and bearing in degrees on a sphere."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(F.col(lon2) - F.col(lon1))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(d / 2), 2)
    km = 2 * C.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    bearing = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return km, F.pmod(bearing + 360.0, F.lit(360.0))


def relate_to_wedges(features: DataFrame, wedges: DataFrame, cell_deg: float = 1.0, only_2s: bool = False, rows: int = CELL_ROWS) -> DataFrame:
    """Features inside each wedge's radius, with distance, bearing and deviation.

    ``features``: ``layer, feature_id, lon, lat``; ``wedges``: ``event_id,
    apex_lon, apex_lat, upwind_deg, half1_deg, half2_deg, radius_km``. Wedge boxes meet the
    features on cells split by their counts, so no cell holds more than ``rows`` features;
    a spherical test, wider than the ellipsoid's by a margin, leaves few other pairs to the
    geodesic. ``only_2s`` returns the features of the wide wedge alone and tests the
    bearing on the sphere, too.
    """
    pad_lat = F.col("radius_km") / 110.5
    pad_lon = F.col("radius_km") / (
        C.EARTH_RADIUS_KM * math.pi / 180.0
        * F.greatest(F.cos(F.radians(F.least(F.abs("apex_lat") + pad_lat, F.lit(89.0)))), F.lit(0.01))
    )
    w = wedges.select(
        "*", (F.col("apex_lon") - pad_lon).alias("_w"), (F.col("apex_lon") + pad_lon).alias("_e"),
        (F.col("apex_lat") - pad_lat).alias("_s"), (F.col("apex_lat") + pad_lat).alias("_n"),
    )
    f, leaves = cell_tree(features, cell_deg, True, rows)
    w = boxes_on_cells(w, leaves, cell_deg, True).drop("_w", "_e", "_s", "_n", "_cw", "_ce", "_cs", "_cn")
    w = w.dropDuplicates(["event_id", "_level", "_i", "_j"])
    w = w.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    km, bearing = _on_sphere("apex_lon", "apex_lat", "lon", "lat")
    near = f.join(w, ["_level", "_i", "_j", "_salt"]).where(km <= F.col("radius_km") * 1.01 + 0.01)
    if only_2s:
        # Bearings on sphere and ellipsoid differ by less than a degree; nearer than 10 m any bearing is tested on the ellipsoid.
        near = near.where((geo.angular_diff(bearing, F.col("upwind_deg")) <= F.col("half2_deg") + 2.0) | (km < 0.01))
    g = near.withColumn("_g", geodesic("apex_lon", "apex_lat", "lon", "lat"))
    dev = geo.angular_diff(F.col("bearing_deg"), F.col("upwind_deg"))
    out = (
        g.withColumn("dist_km", F.col("_g.dist_m") / 1000.0)
        .withColumn("bearing_deg", F.col("_g.azimuth_deg"))
        .where(F.col("dist_km") <= F.col("radius_km"))
        .withColumn("dev_deg", dev)
        .withColumn("in_1s", F.col("dev_deg") <= F.col("half1_deg"))
        .withColumn("in_2s", F.col("dev_deg") <= F.col("half2_deg"))
        .drop("_g", "_level", "_i", "_j", "_salt")
    )
    return out.where("in_2s") if only_2s else out


def rank_candidates(related: DataFrame) -> DataFrame:
    """Candidates inside the wide wedge in order of deviation, then distance, with totals."""
    inside = related.where("in_2s")
    totals = inside.groupBy("event_id").agg(
        F.count("*").alias("n_2s"), F.count(F.when(F.col("in_1s"), 1)).alias("n_1s")
    )
    ranked = exact_row_number(
        inside, ["event_id"], [F.col("dev_deg"), F.col("dist_km"), F.col("feature_id")], F.col("dev_deg"), "rank"
    )
    return ranked.join(totals, "event_id")


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """One row per polygon edge from closed rings of (lon, lat)."""
    ring = F.col("ring")
    return polygons.select(
        "poly_id", F.explode("rings").alias("ring")
    ).select(
        "poly_id",
        F.explode(
            F.arrays_zip(
                F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q")
            )
        ).alias("e"),
    ).select(
        "poly_id", F.col("e.p.lon").alias("x0"), F.col("e.p.lat").alias("y0"),
        F.col("e.q.lon").alias("x1"), F.col("e.q.lat").alias("y1"),
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell_deg: float = 2.0, rows: int = CELL_ROWS) -> DataFrame:
    """(point, polygon) pairs where the polygon contains the point.

    Points at one place, and polygons with equal rings, are tested once: places meet shapes as in
    :func:`places_in_shapes`, and the points and polygons behind them are joined by equality. So the
    geometry grows with the distinct places and shapes, and only the rows returned with the copies.
    """
    at = points.select("point_id", (F.col("lon") + F.lit(0.0)).alias("lon"), (F.col("lat") + F.lit(0.0)).alias("lat"))
    shaped = materialise(polygons.select("poly_id", "rings", F.sha2(F.to_json("rings"), 256).alias("_shape")), "shapes")
    shapes = shaped.groupBy(F.col("_shape").alias("poly_id")).agg(F.first("rings").alias("rings"))
    places = at.select("lon", "lat").distinct()
    met = materialise(places_in_shapes(places, shapes, cell_deg, rows).withColumnRenamed("poly_id", "_shape"), "places-in-shapes")
    return met.join(shaped.drop("rings"), "_shape").join(at, ["lon", "lat"]).select("point_id", "poly_id")


def places_in_shapes(places: DataFrame, polygons: DataFrame, cell_deg: float, rows: int) -> DataFrame:
    """``lon, lat, poly_id`` of the places inside each polygon.

    Polygons are cut once to the cells of the places, which are split by their counts: a cell
    keeps the edges that a ray from it to the east can cross, and a polygon without such edges
    does not reach the cell. So a place meets only the edges of its cell, and no cell holds more
    than ``rows`` places. Containment is the parity of crossings. A place on the lower
    or left boundary counts as inside, on the upper or right as outside.
    """
    edge = lambda a, b: F.struct(a["lon"].alias("x0"), a["lat"].alias("y0"), b["lon"].alias("x1"), b["lat"].alias("y1"))
    ring_edges = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), edge)
    box = polygons.withColumn("_b", geo.points_bbox(F.flatten("rings"))).select(
        "poly_id", F.flatten(F.transform("rings", ring_edges)).alias("_edges"),
        F.col("_b.min_lon").alias("_w"), F.col("_b.max_lon").alias("_e"), F.col("_b.min_lat").alias("_s"), F.col("_b.max_lat").alias("_n"),
    )
    q, leaves = cell_tree(places.select("lon", "lat"), cell_deg, False, rows)
    crossed = F.filter("_edges", lambda e: (
        (e["y0"] != e["y1"]) & (F.greatest(e["x0"], e["x1"]) >= F.col("_cw"))
        & (F.least(e["y0"], e["y1"]) <= F.col("_cn")) & (F.greatest(e["y0"], e["y1"]) >= F.col("_cs"))
    ))
    p = boxes_on_cells(box, leaves, cell_deg, False).withColumn("_edges", crossed).where(F.size("_edges") > 0)
    p = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    lon, lat = F.col("lon"), F.col("lat")
    hit = F.filter("_edges", lambda e: (
        ((e["y0"] > lat) != (e["y1"] > lat)) & (lon < (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    ))
    pair = q.join(p, ["_level", "_i", "_j", "_salt"]).where(lon.between(F.col("_w"), F.col("_e")) & lat.between(F.col("_s"), F.col("_n")))
    return pair.where(F.size(hit) % 2 == 1).select("lon", "lat", "poly_id")


def representative_points(polygons: DataFrame) -> DataFrame:
    """A point inside each polygon: middle of the widest span at mid-latitude."""
    box = polygons.withColumn("_b", geo.points_bbox(F.flatten("rings"))).select(
        "poly_id", ((F.col("_b.min_lat") + F.col("_b.max_lat")) / 2).alias("y")
    )
    e = polygon_edges(polygons).join(box, "poly_id")
    cross = e.where((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))).select(
        "poly_id", "y",
        ((F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")).alias("x"),
    )
    w = W.partitionBy("poly_id").orderBy("x")
    spans = cross.withColumn("_i", F.row_number().over(w)).withColumn("_nx", F.lead("x").over(w)).where(
        F.col("_i") % 2 == 1
    )
    return spans.groupBy("poly_id", "y").agg(
        F.max_by((F.col("x") + F.col("_nx")) / 2, F.struct(F.col("_nx") - F.col("x"), -F.col("x"))).alias("x")
    ).select("poly_id", F.col("x").alias("lon"), F.col("y").alias("lat"))
