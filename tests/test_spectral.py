import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import constants as C
from skyledger.operators import spectral as M

WL = 2130.0 + 25.0 * np.arange(16)


def scene(spark, lines=220, cols=3, seed=0, plume=True, bad=()):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(16, 16)) * 0.02
    cube = 10 + np.linspace(0, 2, 16) + rng.normal(size=(lines, cols, 16)) @ mix + rng.normal(size=(lines, cols, 16)) * 0.01
    k = -np.abs(rng.normal(size=16)) * 1e-5
    if plume:
        cube[20:30] *= 1 + k * 800.0
    rows = [(0, i, j, cube[i, j].tolist(), (i, j) in bad) for i in range(lines) for j in range(cols)]
    px = spark.createDataFrame(rows, "scene_id long, line long, xtrack long, rad array<double>, bad boolean").repartition(5)
    bands = spark.createDataFrame([(0, b, float(WL[b]), float(k[b])) for b in range(16)], "scene_id long, band long, wl double, k double")
    return cube, k, px, bands


def brute(cube, k, bad, alpha=C.SHRINKAGE):
    keep = (WL >= 2137) & (WL <= 2493)
    lines, cols, _ = cube.shape
    out = np.full((lines, cols), np.nan)
    for j in range(cols):
        good = np.array([(i, j) not in bad for i in range(lines)])
        x = cube[:, j, keep]
        mu = x[good].mean(0)
        s = np.cov(x[good], rowvar=False)
        c = (1 - alpha) * s + alpha * np.diag(np.diag(s))
        t = k[keep] * mu
        z = np.linalg.solve(c, t)
        out[good, j] = ((x - mu) @ z / (t @ z))[good]
    return out


def test_matches_dense_algebra_and_finds_the_plume(spark):
    bad = {(3, 0), (7, 2)}
    cube, k, px, bands = scene(spark, bad=bad)
    got = np.full(cube.shape[:2], np.nan)
    for r in M.matched_filter(px, bands, scale=1.0).collect():
        if r.enh is not None:
            got[r.line, r.xtrack] = r.enh
    want = brute(cube, k, bad)
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.nanmax(np.abs(got - want)) < 1e-5 * np.nanmax(np.abs(want))
    assert np.nanmean(got[20:30]) - np.nanmean(got[40:]) > 300


def _with_target(spark, px, bands, make):
    sel = M.select_bands(bands, C.CH4_WINDOWS_NM)
    good = M.project_bands(px, sel)
    mom = M.column_moments(good)
    t = mom.join(sel.select("scene_id", "kept_k"), "scene_id").select("scene_id", "xtrack", make(F.col("kept_k"), F.col("mean")).alias("target"))
    enh = M.apply_filter(good, M.column_models(mom, sel, target=t), 1.0)
    inside = enh.where("line between 20 and 29").agg(F.avg("enh")).first()[0]
    outside = enh.where("line >= 40").agg(F.avg("enh")).first()[0]
    return inside - outside


def test_wrong_signatures_fail(spark):
    _, _, px, bands = scene(spark)
    right = _with_target(spark, px, bands, lambda k, m: M.target_signature(k, m))
    flipped = _with_target(spark, px, bands, lambda k, m: F.transform(M.target_signature(k, m), lambda x: -x))
    doubled = _with_target(spark, px, bands, lambda k, m: M.target_signature(M.target_signature(k, m), m))
    assert right > 300 and flipped == pytest.approx(-right, rel=1e-6) and abs(doubled) < right / 5


def test_short_columns_are_skipped(spark):
    _, _, px, bands = scene(spark, lines=15)
    sel = M.select_bands(bands, C.CH4_WINDOWS_NM)
    good = M.project_bands(px, sel)
    assert {r.status for r in M.column_models(M.column_moments(good), sel).collect()} == {"too few pixels"}
    assert M.matched_filter(px, bands).where("enh is not null").count() == 0


def test_band_windows_are_inclusive(spark):
    bands = spark.createDataFrame([(0, i, w, -1.0) for i, w in enumerate([2136.9, 2137.0, 2493.0, 2493.1])] + [(1, 0, 2200.0, -1.0)], "scene_id long, band long, wl double, k double")
    got = {r.scene_id: (r.kept_bands, r.status) for r in M.select_bands(bands, C.CH4_WINDOWS_NM).collect()}
    assert got[0] == ([1, 2], "ok") and got[1][1] == "too few bands"
    ex = {r.scene_id: r.kept_bands for r in M.select_bands(bands, C.CH4_WINDOWS_NM, (2137.0, 2493.0)).collect()}
    assert ex[0] == [1, 2]


def loo(x):
    x = x * 100.0
    n, b = x.shape
    s = np.cov(x, rowvar=False)
    best, at = np.inf, 0.0
    for i in range(201):
        a = 10.0 ** (-10 + 0.05 * i)
        beta = (1 - a) / (n - 1)
        g = n * beta * s + a * np.diag(np.diag(s))
        sign, ld = np.linalg.slogdet(g)
        r = np.einsum("ij,jk,ik->i", x, np.linalg.inv(g), x)
        q = 1 - beta * r
        if sign <= 0 or np.any(q <= 0):
            continue
        v = 0.5 * (b * np.log(2 * np.pi) + ld) + (np.log(q) + r / q).sum() / (2 * n)
        if v < best:
            best, at = v, a
    return at


@pytest.mark.parametrize("buffer", [48 << 20, 2_000])
@pytest.mark.parametrize("centred", [False, True])
def test_leave_one_out_matches_direct_search(spark, monkeypatch, buffer, centred):
    monkeypatch.setattr(M, "_BUFFER_BYTES", buffer)
    cube, _, px, bands = scene(spark, lines=120, seed=8, plume=False)
    sel = M.select_bands(bands, C.CH4_WINDOWS_NM)
    good = M.project_bands(px, sel)
    got = {r.xtrack: r.alpha for r in M.loo_alpha(good, M.column_moments(good), centred).collect()}
    keep = (WL >= 2137) & (WL <= 2493)
    for j in range(3):
        x = cube[:, j, keep]
        assert got[j] == pytest.approx(loo(x - x.mean(0) if centred else x), rel=1e-9)


def test_leave_one_out_in_rounds_of_scenes(spark):
    _, _, px, bands = scene(spark, lines=60, seed=4, plume=False)
    three = [px.withColumn("scene_id", F.lit(i).cast("long")) for i in (0, 7, 8)]
    px = three[0].unionByName(three[1]).unionByName(three[2])
    bands = bands.crossJoin(spark.createDataFrame([(0,), (7,), (8,)], "s long")).withColumn("scene_id", F.col("s")).drop("s")
    good = M.good_pixels(M.project_bands(px, M.select_bands(bands, C.CH4_WINDOWS_NM)))
    mom = M.column_moments(good)
    systems = M.eigen_systems(mom)
    assert M._rounds(systems, 1) == [(0, 7), (7, 8), (8, 9)] and M._rounds(systems, 1 << 30) == [None]
    at_once = {(r.scene_id, r.xtrack): r.alpha for r in M.loo_alpha(good, mom).collect()}
    assert {(r.scene_id, r.xtrack): r.alpha for r in M.loo_alpha(good, mom, limit=1).collect()} == at_once
    assert len(at_once) == 9


def test_leave_one_out_moves_no_pixels(spark):
    _, _, px, bands = scene(spark, lines=60, plume=False)
    good = M.good_pixels(M.project_bands(px, M.select_bands(bands, C.CH4_WINDOWS_NM)))
    systems = M.eigen_systems(M.column_moments(good))
    plan = M.loo_curve(good.coalesce(2), systems)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, " in plan and "strategy=broadcast" in plan
    flat = px.where("xtrack = 1").withColumn("rad", F.transform("rad", lambda v: F.lit(1.0)))
    still = M.good_pixels(M.project_bands(flat, M.select_bands(bands, C.CH4_WINDOWS_NM)))
    assert [r.alpha for r in M.loo_alpha(still, M.column_moments(still)).collect()] == [0.0]


def test_moments_do_not_depend_on_partitioning(spark):
    _, _, px, bands = scene(spark)
    sel = M.select_bands(bands, C.CH4_WINDOWS_NM)
    one = {r.xtrack: r.m2 for r in M.column_moments(M.project_bands(px.repartition(1), sel)).collect()}
    many = {r.xtrack: r.m2 for r in M.column_moments(M.project_bands(px.repartition(11), sel)).collect()}
    for j in one:
        assert np.allclose(one[j], many[j], rtol=1e-9, atol=1e-12)


def test_bad_pixel_modes(spark):
    df = spark.createDataFrame([([0, 0, 0, 0, 1],), ([1, 0, 0, 0, 0],), ([0, 0],)], "f array<int>")
    got = [(r.a, r.b) for r in df.select(M.bad_pixels(F.col("f")).alias("a"), M.bad_pixels(F.col("f"), False).alias("b")).collect()]
    assert got == [(True, False), (False, True), (False, False)]
