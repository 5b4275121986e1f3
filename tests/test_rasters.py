import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import components as G
from skyledger.operators import plume, raster, stencil


def to_df(spark, arr, scene=0):
    ny, nx = arr.shape
    rows = [(scene, r, c, ny, nx, None if np.isnan(arr[r, c]) else float(arr[r, c])) for r in range(ny) for c in range(nx)]
    return spark.createDataFrame(rows, "scene_id long, r long, c long, ny long, nx long, value double")


def to_arr(rows, shape, col):
    out = np.full(shape, np.nan)
    for r in rows:
        if r[col] is not None:
            out[r.r, r.c] = r[col]
    return out


def pad(arr, h, mode):
    return np.pad(arr, h, mode={"reflect": "symmetric", "nearest": "edge"}[mode])


@pytest.mark.parametrize("shape", [(9, 7), (3, 2), (1, 6)])
def test_box_moments_reflect(spark, shape):
    rng = np.random.default_rng(0)
    a = rng.normal(size=shape)
    a[rng.random(shape) < 0.25] = np.nan
    got = stencil.box_moments(to_df(spark, a), F.col("value"), 5).collect()
    p = pad(a, 2, "reflect")
    for r in got:
        w = p[r.r : r.r + 5, r.c : r.c + 5]
        ok = w[~np.isnan(w)]
        assert r.n_local == len(ok)
        if len(ok):
            assert r.mean_local == pytest.approx(ok.mean())
            assert r.var_local == pytest.approx(ok.var(ddof=1) if len(ok) > 1 else 0.0, abs=1e-9)
        else:
            assert r.mean_local is None


def test_gaussian_and_mean_filters(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((20, 13)) > 0.5).astype(float)
    w = np.array(stencil.gaussian_weights(2.0))
    assert len(w) == 17 and w.sum() == pytest.approx(1.0)
    got = to_arr(stencil.gaussian_smooth(to_df(spark, a), F.col("value"), 2.0, "s").collect(), a.shape, "s")
    p = pad(a, 8, "reflect")
    want = np.array([[(p[i : i + 17, j : j + 17] * np.outer(w, w)).sum() for j in range(13)] for i in range(20)])
    assert np.allclose(got, want)
    a[2, 3] = np.nan
    got = to_arr(stencil.mean_filter(to_df(spark, a), F.col("value"), 3, "m").collect(), a.shape, "m")
    p = pad(np.nan_to_num(a), 1, "nearest")
    assert np.allclose(got, [[p[i : i + 3, j : j + 3].mean() for j in range(13)] for i in range(20)])


def flood(mask, diagonal):
    """Label by flood fill in raster order."""
    lab = np.zeros(mask.shape, int)
    n = 0
    steps = [(a, b) for a, b in itertools.product((-1, 0, 1), repeat=2) if (a or b) and (diagonal or not (a and b))]
    for start in zip(*np.nonzero(mask), strict=True):
        if lab[start]:
            continue
        n += 1
        todo = [start]
        lab[start] = n
        while todo:
            i, j = todo.pop()
            for a, b in steps:
                q = (i + a, j + b)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not lab[q]:
                    lab[q] = n
                    todo.append(q)
    return lab


def snake(n):
    m = np.zeros((n, n), bool)
    for i in range(0, n, 2):
        m[i] = True
        if i + 1 < n:
            m[i + 1, -1 if (i // 2) % 2 == 0 else 0] = True
    return m


@pytest.mark.parametrize("tile", [G.TILE, 7])
@pytest.mark.parametrize("reach", [1, 0])
def test_labels_match_flood_fill(spark, reach, tile):
    rng = np.random.default_rng(11)
    masks = [rng.random((30, 140)) < 0.42, snake(25), np.eye(12, dtype=bool), np.ones((4, 4), bool), rng.random((9, 9)) < 0.2]
    rows = [(s, int(r), int(c)) for s, m in enumerate(masks) for r, c in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "scene_id long, r long, c long").repartition(9)
    got = G.label_regions(df, reach, tile).collect()
    for s, m in enumerate(masks):
        want = flood(m, reach == 1)
        have = np.zeros(m.shape, int)
        for r in got:
            if r.scene_id == s:
                have[r.r, r.c] = r.label
        assert np.array_equal(have, want), s


def test_only_border_pieces_are_linked(spark):
    """A region inside one tile takes no part in the rounds; one across a corner does, with diagonals only."""
    cells = [(0, 1, 1), (0, 1, 2), (0, 3, 3), (0, 4, 4), (0, -1, 2), (1, 0, 0)]
    pieces = G.tile_pieces(spark.createDataFrame(cells, "scene_id long, r long, c long"), 1, 4)
    assert {(r.r, r.c): r.piece for r in pieces.where("scene_id = 0 and r = 1").collect()} == {(1, 1): (1 << 32) + 1, (1, 2): (1 << 32) + 1}
    assert [(r.scene_id, r.a, r.b) for r in G.crossing_edges(pieces, 1, 4).collect()] == [(0, 3 * (1 << 32) + 3, 4 * (1 << 32) + 4)]
    assert G.crossing_edges(pieces, 0, 4).count() == 0
    assert G.label_regions(spark.createDataFrame([], "scene_id long, r long, c long")).count() == 0


def test_labels_do_not_depend_on_partitioning(spark):
    m = np.random.default_rng(2).random((20, 20)) < 0.45
    rows = [(0, int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "scene_id long, r long, c long")
    a = sorted(map(tuple, G.label_regions(df.repartition(1)).collect()))
    b = sorted(map(tuple, G.label_regions(df.orderBy(F.rand(3)).repartition(13)).collect()))
    assert a == b


def test_outline_areas_and_holes(spark):
    m = np.ones((5, 5), bool)
    m[2, 2] = False
    rows = [(0, int(r), int(c), 1) for r, c in zip(*np.nonzero(m), strict=True)]
    o = G.outlines(spark.createDataFrame(rows, "scene_id long, r long, c long, label long")).collect()
    assert sorted((x.area_cells, x.is_hole) for x in o) == [(1.0, True), (25.0, False)]
    rows = [(0, 0, 0, 1), (0, 1, 1, 1)]
    o = G.outlines(spark.createDataFrame(rows, "scene_id long, r long, c long, label long")).collect()
    assert sum(x.area_cells for x in o) == 2.0 and all(x.points[0] == x.points[-1] for x in o)


def test_two_bright_features_become_two_plumes(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 30, size=(60, 60))
    a[10:22, 10:22] += 400
    a[38:52, 36:50] += 400
    d = to_df(spark, a)
    bg = (F.col("r") < 5) | (F.col("r") > 55)
    lab = plume.segment(d, bg).collect()
    inside = {r.label for r in lab if 12 <= r.r < 20 and 12 <= r.c < 20}
    other = {r.label for r in lab if 40 <= r.r < 50 and 38 <= r.c < 48}
    assert len(inside) == len(other) == 1 and inside != other


def test_small_background_has_a_status(spark):
    b = plume.background(to_df(spark, np.ones((4, 4))), F.col("r") == 0).first()
    assert b.status == "background too small" and b.bg_n == 4


def test_ortho_clips_and_masks(spark):
    raw = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 2.0)], "scene_id long, line long, xtrack long, value double")
    glt = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 1, 9, 9), (0, 1, 0, 0, 1)], "scene_id long, oy long, ox long, glt_x long, glt_y long")
    ext = spark.createDataFrame([(0, 2, 2)], "scene_id long, n_lines long, n_cols long")
    got = {(r.oy, r.ox): r.value for r in raster.orthorectify(raw, glt, ext).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None}


def test_shape_mismatch_is_reported(spark):
    a, b = to_df(spark, np.ones((3, 3))), to_df(spark, np.ones((2, 3)))
    p = raster.pair_rasters(a.select("scene_id", "r", "c", "value"), b.select("scene_id", "r", "c", "value"))
    assert {r.status for r in p.collect()} == {"grid mismatch"}


def test_wind_at_the_source_moves_the_rate(spark):
    """Wind from the west over a mask of one row: the source is its west end, where the wind is three times as strong."""
    cells = [(s, 10.0 + 0.01 * i, 20.0, 500.0, 3600.0, 40.0) for s in (1, 2, 3) for i in range(40)]
    cells = spark.createDataFrame(cells, "scene_id long, lon double, lat double, enh double, area_m2 double, n_air double")
    when = spark.createDataFrame([(1, 1800), (2, 90_000), (3, 1800)], "scene_id long, t long")
    samples = [(k, t, u, 0.0) for k, u in ((0, 6.0), (1, 2.0)) for t in (0, 3600)]
    samples = spark.createDataFrame(samples, "k long, ts long, u double, v double")
    place = lambda p: p.withColumn("k", F.when(F.col("lon") < 10.05, 0).when(F.col("scene_id") == 3, 7).otherwise(1).cast("long"))
    got = {r.scene_id: r for r in plume.source_wind_check(cells, when, samples, ["k"], place).collect()}
    assert got[1].status == "ok" and (got[1].u10_centroid, got[1].u10_source, got[1].delta_u10) == (2.0, 6.0, 4.0)
    assert got[1].source_lon == pytest.approx(10.005, abs=0.006) and got[1].material and got[1].rel_delta == pytest.approx((np.log(6) + 0.6) / (np.log(2) + 0.6) - 1)
    assert got[2].status == got[3].status == "no wind at centroid" and got[2].q_centroid is None and got[3].dist_km is None


def test_significance_levels_share_one_segmentation(spark):
    rng = np.random.default_rng(9)
    grid = rng.normal(0, 1, (40, 40))
    grid[10:22, 10:24] += 1.2
    dense = [(5, r, c, 40, 40, float(grid[r, c])) for r in range(40) for c in range(40)]
    dense = spark.createDataFrame(dense, "scene_id long, r long, c long, ny long, nx long, value double")
    box = F.col("r").between(5, 28) & F.col("c").between(5, 28)
    facts = dense.select("scene_id", "r", "c", box.alias("inside"), (F.col("value") + 5).alias("enh"), F.lit(3600.0).alias("area_m2"), F.lit(40.0).alias("n_air"), F.lit(4.0).alias("u10"), F.lit(1.0).alias("u10_sigma"))
    rows = {r.p_value: r for r in plume.p_value_sweep(dense, ~box, facts, (1e-12, 0.01, 0.05, 0.1)).collect()}
    assert rows[1e-12].n_px == 0 and rows[1e-12].q_t_h is None
    assert 100 < rows[0.01].n_px <= rows[0.05].n_px <= rows[0.1].n_px
    rates = [rows[p].q_t_h for p in (0.01, 0.05, 0.1)]
    assert rows[0.05].spread == pytest.approx((max(rates) - min(rates)) / rows[0.05].q_t_h)
    for p in (0.01, 0.1):
        labels = plume.segment(dense, ~box, p).join(facts, ["scene_id", "r", "c"])
        first = labels.where("inside").groupBy("label").count().orderBy(F.desc("count"), "label").first().label
        assert labels.where(F.col("label") == first).count() == rows[p].n_px


def test_blob_columns_hold_every_bright_pixel(spark, sf):
    from skyledger.workload import QUERIES
    from skyledger.workload import fixtures as X

    scenes = {}
    for r in X.v_raster(spark, sf).where("own is not null").select("scene_id", "own").collect():
        scenes.setdefault(r.scene_id, []).append(abs(r.own))
    rows = QUERIES["a17_blob_columns"](spark, sf).collect()
    for scene, values in scenes.items():
        own = [r for r in rows if r.scene_id == scene]
        assert sum(r.n for r in own) == int((np.array(values) > np.quantile(values, 0.99)).sum())
        assert sum(r.n_top for r in own) == int((np.array(values) > np.quantile(values, 0.999)).sum())
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
