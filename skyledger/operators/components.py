"""Connected regions of a mask, and questions about them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW = 1 << 32


def _relax(edges: DataFrame, small: bool) -> DataFrame:
    """One star step of the alternating contraction (Kiveris et al., 2014)."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    if small:
        directed = edges.select("scene_id", F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        lowest = directed.groupBy("scene_id", "u").agg(F.min("v").alias("m"))
        moved = directed.join(lowest, ["scene_id", "u"])
        pairs = moved.where(v != m).select("scene_id", v.alias("u"), m.alias("v")).unionByName(
            lowest.select("scene_id", "u", m.alias("v"))
        )
    else:
        both = edges.unionByName(edges.select("scene_id", v.alias("u"), u.alias("v")))
        lowest = both.groupBy("scene_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        pairs = both.join(lowest, ["scene_id", "u"]).where(v > u).select("scene_id", v.alias("u"), m.alias("v"))
    pairs = pairs.where(F.col("u") != F.col("v"))
    return pairs.distinct()


def region_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of each node's region: ``(scene_id, node, root)``.

    Alternates large-star and small-star steps over all scenes at once. Only a
    fingerprint of the edge set reaches the driver per round; each round is
    checkpointed.
    """
    current = cut_lineage(edges.select("scene_id", F.col("a").alias("u"), F.col("b").alias("v")))
    stamp = F.sum(F.xxhash64("scene_id", "u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        current = cut_lineage(_relax(_relax(current, small=False), small=True))
        now = tuple(current.agg(F.count("*"), stamp).first())
        if now == before:
            break
        before = now
    roots = current.select("scene_id", F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("scene_id", "node").join(roots, ["scene_id", "node"], "left").select(
        "scene_id", "node", F.coalesce("root", "node").alias("root")
    )


#: Side of a tile in cells; a task labels one tile at a time, so at most its square of cells.
TILE = 512


def _overlaps(r, c0, c1, reach: int):
    """Index pairs of runs (sorted by row and column) that touch in neighbouring rows."""
    width = int(c1.max()) + 2 * reach + 2
    begin, end = r * width + c0, r * width + c1
    lo = np.searchsorted(end, begin - width - reach, "left")
    hi = np.searchsorted(begin, end - width + reach, "right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(r)), n)
    return below, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _united(n: int, a, b):
    """Smallest index of each index's set after uniting ``a[i]`` with ``b[i]``: hook the larger root, then halve paths."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def tile_pieces(mask: DataFrame, reach: int = 1, tile: int = TILE) -> DataFrame:
    """Set cells with the piece of a region they form within their tile: ``scene_id, r, c, piece``.

    A piece is named by its first cell in raster order. Each tile is labelled by itself, on its
    runs of cells, by a union-find over whole arrays.
    """
    kind = mask.schema["scene_id"].dataType.simpleString()

    def label(group: pa.Table) -> pa.Table:
        r, c = group.column("r").to_numpy(), group.column("c").to_numpy()
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        first = np.r_[True, (np.diff(r) != 0) | (np.diff(c) > 1)]
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        c0, c1 = c[starts], c[np.r_[starts[1:], len(c)] - 1]
        r_off, c_off = r.min(), c.min()
        a, b = _overlaps(r[starts] - r_off + 1, c0 - c_off, c1 - c_off, reach)
        root = starts[_united(len(starts), a, b)][run]
        return pa.table({"scene_id": group.column("scene_id").take(pa.array(order)), "r": r, "c": c, "piece": r[root] * _ROW + c[root]})

    r, c = F.col("r").cast("bigint"), F.col("c").cast("bigint")
    placed = mask.select("scene_id", r.alias("r"), c.alias("c"), F.floor(r / tile).alias("_tr"), F.floor(c / tile).alias("_tc"))
    return placed.groupBy("scene_id", "_tr", "_tc").applyInArrow(label, f"scene_id {kind}, r bigint, c bigint, piece bigint")


def crossing_edges(pieces: DataFrame, reach: int = 1, tile: int = TILE) -> DataFrame:
    """Links between pieces that touch across a tile border: ``scene_id, a, b``. Only border cells take part."""
    r, c = F.pmod("r", F.lit(tile)), F.pmod("c", F.lit(tile))
    border = pieces.where(r.isin(0, tile - 1) | c.isin(0, tile - 1))
    back = [(-1, 0), (0, -1), (-1, -1), (-1, 1)] if reach else [(-1, 0), (0, -1)]
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in back])
    seen = border.select("scene_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("piece").alias("b"), F.explode(steps).alias("s"))
    seen = seen.select("scene_id", "r0", "c0", "b", (F.col("r0") + F.col("s.dr")).alias("r"), (F.col("c0") + F.col("s.dc")).alias("c"))
    tile_of = lambda v: F.floor(F.col(v) / tile)
    seen = seen.where((tile_of("r") != tile_of("r0")) | (tile_of("c") != tile_of("c0")))
    met = seen.join(border.select("scene_id", "r", "c", F.col("piece").alias("a")), ["scene_id", "r", "c"])
    return met.select("scene_id", "a", "b").distinct()


def label_regions(mask: DataFrame, reach: int = 1, tile: int = TILE) -> DataFrame:
    """Set cells with their region label, numbered per scene in raster order from 1.

    Tiles are labelled by themselves; the rounds of :func:`region_roots` see only pieces that
    touch another tile, and there are none where scenes fit into tiles.
    """
    pieces = cut_lineage(tile_pieces(mask, reach, tile))
    edges = cut_lineage(crossing_edges(pieces, reach, tile))
    named = pieces.select("scene_id", "piece").distinct()
    if edges.isEmpty():
        named = named.withColumn("root", F.col("piece"))
    else:
        ends = edges.select("scene_id", F.col("a").alias("node")).union(edges.select("scene_id", "b")).distinct()
        roots = region_roots(ends, edges).select("scene_id", F.col("node").alias("piece"), "root")
        named = named.join(roots, ["scene_id", "piece"], "left").withColumn("root", F.coalesce("root", "piece"))
    order = W.partitionBy("scene_id").orderBy("root")
    numbers = named.withColumn("label", F.dense_rank().over(order).cast("bigint"))
    return pieces.join(numbers, ["scene_id", "piece"]).select("scene_id", "r", "c", "label")


def region_counts(labels: DataFrame, extents: DataFrame) -> DataFrame:
    """Cells per label, label 0 holding the background."""
    found = labels.groupBy("scene_id", "label").agg(F.count("*").alias("n_cells"))
    used = found.groupBy("scene_id").agg(F.sum("n_cells").alias("_used"))
    rest = extents.join(used, "scene_id", "left").select(
        "scene_id", F.lit(0).cast("bigint").alias("label"),
        (F.col("ny") * F.col("nx") - F.coalesce("_used", F.lit(0))).cast("bigint").alias("n_cells"),
    )
    return found.unionByName(rest)


def largest_in_box(labels: DataFrame, scenes: DataFrame, inside: Column) -> DataFrame:
    """Label with most cells inside a box (ties: lowest label; none: 0), per scene."""
    counts = labels.where(inside).groupBy("scene_id", "label").agg(F.count("*").alias("n_inside"))
    best = counts.groupBy("scene_id").agg(
        F.max_by(F.struct("label", "n_inside"), F.struct(F.col("n_inside"), -F.col("label"))).alias("_b")
    )
    return scenes.select("scene_id").join(best, "scene_id", "left").select(
        "scene_id",
        F.coalesce("_b.label", F.lit(0)).cast("bigint").alias("label"),
        F.coalesce("_b.n_inside", F.lit(0)).cast("bigint").alias("n_inside"),
    )


def label_at(labels: DataFrame, points: DataFrame, extents: DataFrame) -> DataFrame:
    """Label of the cell nearest each point; a point off the raster gets a status.

    ``points`` carries ``scene_id``, ``point_id``, ``lon``, ``lat``; ``extents``
    carries the affine origin and step of cell centres.
    """
    p = points.join(extents, "scene_id")
    c = F.round((F.col("lon") - F.col("lon0")) / F.col("dlon")).cast("bigint")
    r = F.round((F.col("lat") - F.col("lat0")) / F.col("dlat")).cast("bigint")
    keyed = p.withColumn("c", c).withColumn("r", r).withColumn(
        "status",
        F.when(c.between(0, F.col("nx") - 1) & r.between(0, F.col("ny") - 1), "ok").otherwise("outside"),
    )
    return keyed.join(labels, ["scene_id", "r", "c"], "left").select(
        "scene_id", "point_id", "status",
        F.when(F.col("status") == "ok", F.coalesce("label", F.lit(0)).cast("bigint")).alias("label"),
    )


def largest_cluster_box(mask_labels: DataFrame, extents: DataFrame) -> DataFrame:
    """Bounding box of the largest region, widened by half a cell (ties: lowest label)."""
    lon = F.col("lon0") + F.col("c") * F.col("dlon")
    lat = F.col("lat0") + F.col("r") * F.col("dlat")
    boxes = (
        mask_labels.join(extents, "scene_id")
        .groupBy("scene_id", "label", "dlon", "dlat")
        .agg(
            F.count("*").alias("n_cells"),
            F.min(lon).alias("_w"), F.max(lon).alias("_e"), F.min(lat).alias("_s"), F.max(lat).alias("_n"),
        )
    )
    hx, hy = F.abs("dlon") / 2, F.abs("dlat") / 2
    row = F.struct(
        "label", "n_cells", (F.col("_w") - hx).alias("min_lon"), (F.col("_s") - hy).alias("min_lat"),
        (F.col("_e") + hx).alias("max_lon"), (F.col("_n") + hy).alias("max_lat"),
    )
    return boxes.groupBy("scene_id").agg(
        F.max_by(row, F.struct(F.col("n_cells"), -F.col("label"))).alias("_b")
    ).select("scene_id", "_b.*")


def boundary_edges(labels: DataFrame) -> DataFrame:
    """Directed outline edges per region: cell sides that belong to one cell only.

    Sides run clockwise on screen, so the inside always lies to the right.
    """
    r, c = F.col("r"), F.col("c")

    def side(r0, c0, r1, c1):
        return F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))

    sides = F.array(
        side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1),
        side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c),
    )
    e = labels.select("scene_id", "label", F.explode(sides).alias("e")).select(
        "scene_id", "label", "e.*",
        F.least(F.struct("e.r0", "e.c0"), F.struct("e.r1", "e.c1").cast("struct<r0:bigint,c0:bigint>")).alias("_lo"),
        F.greatest(F.struct("e.r0", "e.c0"), F.struct("e.r1", "e.c1").cast("struct<r0:bigint,c0:bigint>")).alias("_hi"),
    )
    return (
        e.groupBy("scene_id", "label", "_lo", "_hi")
        .agg(F.count("*").alias("_n"), F.first(F.struct("r0", "c0", "r1", "c1")).alias("e"))
        .where("_n = 1")
        .select("scene_id", "label", "e.*")
    )


_RINGS = (
    "scene_id bigint, label bigint, ring int, area_cells double, is_hole boolean, "
    "points array<struct<r:bigint,c:bigint>>"
)


def _stitch_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the outline edges of a group of regions into closed rings."""
    edges = pdf.sort_values(["label", "r0", "c0", "r1", "c1"])
    starts = list(zip(edges.label, edges.r0, edges.c0, strict=True))
    ends = list(zip(edges.r1, edges.c1, strict=True))
    onward: dict[tuple, list] = {}
    for key, end in zip(starts, ends, strict=True):
        onward.setdefault(key, []).append(end)
    rows = []
    count: dict[int, int] = {}
    for label, r, c in starts:
        while onward.get((label, r, c)):
            ring = _trace(onward, label, (r, c))
            area2 = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False))
            k = count[label] = count.get(label, -1) + 1
            rows.append((pdf.scene_id.iloc[0], label, k, abs(area2) / 2.0, area2 < 0, [{"r": p[0], "c": p[1]} for p in ring]))
    return pd.DataFrame(rows, columns=["scene_id", "label", "ring", "area_cells", "is_hole", "points"])


def _trace(onward: dict[tuple, list], label: int, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Follow unused edges from ``start`` back to it.

    At a pinch point the path turns right, which keeps diagonal cells in one
    ring apart.
    """
    ring, at, heading = [start], start, None
    while True:
        out = onward[(label, *at)]
        pick = 0
        if len(out) > 1 and heading is not None:
            right = (at[0] + heading[1], at[1] - heading[0])
            pick = out.index(right) if right in out else 0
        to = out.pop(pick)
        heading = (to[0] - at[0], to[1] - at[1])
        ring.append(to)
        at = to
        if at == start:
            return ring


def outlines(labels: DataFrame, groups: int = 16) -> DataFrame:
    """Closed outline rings per region, to be sorted by ``area_cells`` for display.

    Only the outline, which is bounded by the sensor's raster size, is grouped;
    a scene's regions are shared out over ``groups`` groups.
    """
    e = boundary_edges(labels).withColumn("_g", F.pmod("label", F.lit(groups)))
    return e.groupBy("scene_id", "_g").applyInPandas(lambda pdf: _stitch_all(pdf), _RINGS)
