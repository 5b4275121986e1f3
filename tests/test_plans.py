import numpy as np
from pyspark.sql import functions as F

from skyledger.plans.evaluation import run_evaluation
from skyledger.plans.heat_lane import heat_lane
from skyledger.plans.plume_event import enhancement_maps, quantify_scenes
from skyledger.plans.source_attribution import attribute_sources
from skyledger.workload import fixtures as X
from skyledger.workload import q_eval


def test_heat_lane(spark, sf):
    land = X.v_land(spark, sf)
    anchors = land.select("region_id").distinct().withColumn("anchor", F.lit(120).cast("bigint"))
    variants = [("central", 1995, 2000, 10), ("early", 1995, 1997, 10), ("late", 1998, 2000, 10), ("wide", 1995, 2000, 15)]
    out = heat_lane(X.v_days(spark, sf), land, anchors, 2001, 0.05, (60, 200), variants)
    assert out["summary"].count() == land.select("region_id").distinct().count()
    b = out["budget"].first()
    assert b.half_spread >= 0 and b.window_shift >= 0
    assert out["duration"].where("status is not null").count() > 0


def test_evaluation_transforms_events(spark, sf):
    ev = X.v_events(spark, sf)
    dets = X.v_dets(spark, sf)
    out = run_evaluation(lambda e: dets.join(e.select("event_id"), "event_id", "left_semi"), ev, X.v_refs(spark, sf), q_eval._checks(spark, sf), "1998-07-14 00:00:00")
    s = out["scores"].first()
    assert s.n_events == 25 and s.n_runnable < 25 and 0 < s.precision < 1


def test_sources(spark, sf):
    plumes = X.v_wedges(spark, sf)
    feats = X.v_points(spark, sf).withColumn("operator", F.col("layer"))
    out = attribute_sources(plumes, feats, X.v_polys(spark, sf), 400.0, cell_deg=2.0)
    assert out["facility"].count() == 3 * out["summary"].count()
    assert out["field"].count() == 3 * plumes.count()
    assert out["alternatives"].where("alt > 8").count() == 0


def test_radiance_to_rate(spark):
    rng = np.random.default_rng(6)
    n, cols, b = 40, 30, 6
    k = -np.array([3.0, 1.0, 4.0, 1.5, 5.0, 2.0]) * 1e-4
    cube = 10 + rng.normal(size=(n, cols, b)) * 0.02
    cube[10:20, 8:18] *= 1 + k * 200
    px = spark.createDataFrame([(0, i, j, cube[i, j].tolist(), False) for i in range(n) for j in range(cols)], "scene_id long, line long, xtrack long, rad array<double>, bad boolean")
    bands = spark.createDataFrame([(0, i, 2150.0 + 50 * i, float(k[i])) for i in range(b)], "scene_id long, band long, wl double, k double")
    glt = spark.createDataFrame([(0, i, j, j + 1, i + 1) for i in range(n) for j in range(cols)], "scene_id long, oy long, ox long, glt_x long, glt_y long")
    own = enhancement_maps(px, bands, glt, spark.createDataFrame([(0, n, cols)], "scene_id long, n_lines long, n_cols long"), scale=1.0)
    ref = spark.createDataFrame([(0, i, j, 150.0 if 10 <= i < 20 and 8 <= j < 18 else 0.0) for i in range(n) for j in range(cols)], "scene_id long, r long, c long, value double")
    affine = spark.createDataFrame([(0, 50.0, 40.0, 0.001, -0.001)], "scene_id long, lon0 double, lat0 double, dlon double, dlat double")
    boxes = spark.createDataFrame([(0, 49.0, 39.0, 51.0, 41.0)], "scene_id long, min_lon double, min_lat double, max_lon double, max_lat double")
    state = spark.createDataFrame([(0, 1800, 100000.0, 300.0, 39.0, 49.0)], "scene_id long, t long, pressure double, temperature double, glat0 double, glon0 double")
    weather = spark.createDataFrame([(i, j, t, 3.0, 4.0) for i in range(10) for j in range(10) for t in (0, 3600)], "cell_i long, cell_j long, ts long, u double, v double")
    out = quantify_scenes(own, ref, affine, boxes, state, weather, [50.0, 100.0], 100.0)
    q = out["estimate"].first()
    assert q.n_px == 100 and q.u10 == 5.0 and q.q_t_h > 0 and q.bounds.low < q.bounds.high
    assert q.rel_delta_source < 1e-12
    # Expected agreement from dense algebra on the same cube.
    dense, truth = np.empty((n, cols)), np.zeros((n, cols))
    truth[10:20, 8:18] = 150.0
    for j in range(cols):
        mu, s = cube[:, j].mean(0), np.cov(cube[:, j], rowvar=False)
        z = np.linalg.solve((1 - 1e-9) * s + 1e-9 * np.diag(np.diag(s)), k * mu)
        dense[:, j] = (cube[:, j] - mu) @ z / ((k * mu) @ z)
    want = np.corrcoef(dense.ravel(), truth.ravel())[0, 1]
    assert abs(out["agreement"].first().pearson_full - want) < 1e-6
