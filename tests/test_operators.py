import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import calendar as K
from skyledger.functions.numeric import geodesic_inverse
from skyledger.operators import asof, attribution, audit, climate, matching, quality, raster, runs, spatial, surface
from skyledger.session import scratch_path
from skyledger.sources import catalogue, grids, stations


def days(spark, fracs, region=1):
    return spark.createDataFrame([(region, i, float(f)) for i, f in enumerate(fracs)], "region_id long, pos long, area_frac double")


def run_at(spark, fracs, anchor):
    a = spark.createDataFrame([(1, anchor)], "region_id long, anchor long")
    return runs.anchored_run(days(spark, fracs), a, 0.05, ["region_id"]).first()


def test_anchored_run(spark):
    f = [0.0, 0.1, 0.2, 0.05, 0.0, 0.3]
    r = run_at(spark, f, 2)
    assert (r.status, r.run_start, r.run_end, r.n_days, r.touches_edge) == ("ok", 1, 3, 3, False)
    assert run_at(spark, f, 5).touches_edge is True
    assert run_at(spark, f, 4).status == "anchor below threshold"
    assert run_at(spark, f, 40).status == "anchor not computed"


def test_gap_runs_follow_the_loop(spark):
    rng = np.random.default_rng(9)
    f = (rng.random(300) < 0.55).astype(float)
    want, run, gap = [], [], 0
    for i, x in enumerate(f):
        if x >= 0.5:
            run.append(i)
            gap = 0
        elif run and gap < 1:
            gap += 1
        else:
            if len(run) >= 3:
                want.append((run[0], run[-1], len(run)))
            run, gap = [], 0
    if len(run) >= 3:
        want.append((run[0], run[-1], len(run)))
    d = days(spark, f).withColumn("severity", F.lit(1.0)).withColumn("peak_anomaly", F.lit(1.0)).withColumn("centroid_i", F.lit(0.0)).withColumn("centroid_j", F.lit(0.0))
    got = runs.summarise_runs(runs.gap_runs(d, ["region_id"], 0.5), ["region_id"]).collect()
    assert sorted((r.start_pos, r.end_pos, r.n_days) for r in got) == want


def test_climatology_pools_samples_and_clips(spark):
    rows = [(1, 0, 0, 2000, 0, 10.0), (1, 0, 0, 2000, 1, 20.0), (1, 0, 0, 2001, 1, 60.0), (1, 0, 0, 2002, 0, 50.0), (1, 0, 0, 2002, 3, None)]
    g = spark.createDataFrame(rows, "region_id long, lat_i long, lon_i long, year long, day_idx long, tmax double")
    c = climate.window_climatology(g, 2002, [("v", 2000, 2001, 1)], n_days=4, computable_only=False).collect()
    assert [(r.day_idx, r.clim, r.clim_n) for r in c] == [(0, 30.0, 3)]
    p = {r.day_idx: (r.pctl, r.n_pool) for r in climate.window_percentile(g, 2000, 2001, 1, 0.5, n_days=4).collect()}
    assert p == {0: (20.0, 3), 1: (20.0, 3), 2: (40.0, 2)}


def test_qualifying_needs_both_tests(spark):
    df = spark.createDataFrame([(313.15, 308.65), (313.15, 309.0), (312.0, 300.0), (None, 300.0), (320.0, None)], "t double, c double")
    got = [r[0] for r in df.select(climate.qualifies(F.col("t"), F.col("c"), F.lit(True))).collect()]
    assert got == [True, False, False, False, False]


def test_leap_day_has_no_position(spark):
    df = spark.sql("select explode(array(date'2000-02-28', date'2000-02-29', date'2000-03-01', date'2001-03-01', date'2000-12-31')) d")
    assert [r[0] for r in df.select(K.common_year_index(F.col("d"))).collect()] == [58, None, 59, 59, 364]


def test_bracket_interpolation(spark):
    s = spark.createDataFrame([(0, 0, 0.0), (0, 3600, 10.0), (0, 20000, 5.0), (2, 3600, 0.0), (2, 10800, 10.0), (3, 0, 0.0), (3, 3600, 10.0), (4, 50, 7.0)], "k long, ts long, u double")
    r = spark.createDataFrame([(0, 1, 900), (0, 2, 3600), (0, 3, 9000), (1, 5, 0), (2, 6, 5400), (3, 7, 5400), (4, 8, 0), (3, 9, -1800)], "k long, request_id long, t long")
    for block in (asof.BLOCK_S, 1000):
        got = {x.request_id: (x.u, x.status, x.hour_distance) for x in asof.bracket_interpolate(r, s, ["k"], ["u"], block_s=block).collect()}
        assert got[1] == (2.5, "ok", 0.25) and got[2] == (10.0, "ok", 0.0)
        assert got[3] == (None, "no sample", None) and got[5] == (None, "no sample", None)
        assert got[6][0] == 2.5 and got[7][0] == 15.0 and got[8][0] == 7.0 and got[9][0] == -5.0


def test_wedge_across_the_date_line(spark):
    f = spark.createDataFrame([("w", 1, -179.9, 0.0), ("w", 2, 179.9, 0.0), ("w", 3, 175.0, 0.0), ("w", 4, 179.99, 0.3)], "layer string, feature_id long, lon double, lat double")
    w = spark.createDataFrame([(7, 179.95, 0.0, 90.0, 10.0, 20.0, 60.0)], "event_id long, apex_lon double, apex_lat double, upwind_deg double, half1_deg double, half2_deg double, radius_km double")
    for rows in (1, 4096):
        got = {r.feature_id: (r.in_1s, r.in_2s) for r in spatial.relate_to_wedges(f, w, 0.5, rows=rows).collect()}
        assert got == {1: (True, True), 2: (False, False), 4: (False, False)}
        assert [r.feature_id for r in spatial.relate_to_wedges(f, w, 0.5, True, rows).collect()] == [1]


def test_crowded_cells_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    at = np.r_[rng.normal(0, 0.05, (150, 2)), rng.uniform(-3, 3, (150, 2)), np.tile([[1.0, 1.0]], (40, 1))] + [179.0, 88.0 - 60]
    f = spark.createDataFrame([("w", i, float((x + 180) % 360 - 180), float(y)) for i, (x, y) in enumerate(at)], "layer string, feature_id long, lon double, lat double")
    wedges = [(k, float((at[7 * k][0] + 180) % 360 - 180), float(at[7 * k][1]) + 0.01, 37.0 * k % 360, 15.0, 40.0, 20.0 + 9 * k) for k in range(30)]
    w = spark.createDataFrame(wedges, "event_id long, apex_lon double, apex_lat double, upwind_deg double, half1_deg double, half2_deg double, radius_km double")
    d, az = geodesic_inverse(*(np.array(x) for x in zip(*[(a[1], a[2], (x + 180) % 360 - 180, y) for a in wedges for x, y in at], strict=True)))
    pairs = [(a[0], i, a[3], a[5], a[6]) for a in wedges for i in range(len(at))]
    near = {(e, i): min(abs(z - up), 360 - abs(z - up)) <= h for (e, i, up, h, rad), m, z in zip(pairs, d, az, strict=True) if m / 1000 <= rad}
    for rows in (5, 4096):
        got = [(r.event_id, r.feature_id, r.in_2s) for r in spatial.relate_to_wedges(f, w, 1.0, rows=rows).collect()]
        assert len(got) == len(near) and {(e, i): s for e, i, s in got} == near
        wide = [(r.event_id, r.feature_id) for r in spatial.relate_to_wedges(f, w, 1.0, True, rows).collect()]
        assert sorted(wide) == sorted(k for k, s in near.items() if s)
    tree, leaves = spatial.cell_tree(f, 1.0, True, 5)
    assert max(r["count"] for r in tree.groupBy("_level", "_i", "_j", "_salt").count().collect()) <= 20 and leaves.where("_level > 3").count()


def test_polygons_cut_to_crowded_cells(spark):
    rng = np.random.default_rng(4)
    at = np.r_[rng.uniform(-6, 6, (300, 2)), np.tile([[0.5, 0.5]], (30, 1)), rng.integers(-3, 4, (60, 2))]
    polys = []
    for k in range(25):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
        ring = rng.uniform(-3, 3, 2) + rng.uniform(0.2, 4, (9, 1)) * np.c_[np.cos(turn), np.sin(turn)]
        polys.append((k, [np.r_[ring, ring[:1]].tolist()]))
    polys.append((25, [[[-3.0, -3.0], [3.0, -3.0], [3.0, 3.0], [-3.0, 3.0], [-3.0, -3.0]]]))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "point_id long, lon double, lat double")
    shape = spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in r] for r in rings]) for k, rings in polys], "poly_id long, rings array<array<struct<lon:double,lat:double>>>")
    want = sorted((i, k) for i, (x, y) in enumerate(at) for k, (ring,) in polys
                  if sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2)
    for rows in (3, 4096):
        assert sorted(map(tuple, spatial.points_in_polygons(pts, shape, 2.0, rows).collect())) == want


def test_concave_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    hole = [(0.2, 0.2), (0.6, 0.2), (0.6, 0.6), (0.2, 0.6), (0.2, 0.2)]
    row = (1, [[{"lon": float(a), "lat": float(b)} for a, b in r] for r in (ring, hole)])
    poly = spark.createDataFrame([row], "poly_id long, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(1, 0.5, 3.0), (2, 2.0, 2.0), (3, 3.5, 1.0), (4, 0.4, 0.4), (5, 9.0, 1.0)], "point_id long, lon double, lat double")
    assert sorted(r.point_id for r in spatial.points_in_polygons(pts, poly, 1.0).collect()) == [1, 3]
    p = spatial.representative_points(poly).withColumnRenamed("poly_id", "point_id")
    assert spatial.points_in_polygons(p, poly, 1.0).count() == 1


def test_open_ended_event_and_order_of_reasons(spark):
    d = spark.createDataFrame(
        [(1, 9, "a", 0.0, 0.0, dt.datetime(2020, 1, 5), None), (2, 9, "b", 0.0, 0.0, dt.datetime(2020, 1, 5), None), (3, 9, "a", 0.0, 0.0, dt.datetime(2019, 1, 5), None), (4, 9, "a", 5.0, 0.0, dt.datetime(2020, 1, 5), None)],
        "det_id long, event_id long, type string, lon double, lat double, t0 timestamp_ntz, t1 timestamp_ntz").withColumn(
        "footprint", F.lit(None).cast("struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"))
    e = spark.createDataFrame([(9, ["a"], dt.datetime(2020, 1, 1), None, 0.0, 0.0, None, False)],
                              "event_id long, expected_types array<string>, e_t0 timestamp_ntz, e_t1 timestamp_ntz, e_lon double, e_lat double, precision_km double, is_area boolean").withColumn(
        "e_box", F.lit(None).cast("struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"))
    got = {r.det_id: r.reason for r in matching.judge(d, e).collect()}
    assert got == {1: "matched", 2: "type", 3: "time", 4: "space"}


def test_recall_counts_errors_as_misses(spark):
    runs_ = spark.createDataFrame([(1, "ran", 2.0), (2, "error", 4.0), (3, "not_runnable", 99.0)], "event_id long, status string, latency_s double")
    judged = spark.createDataFrame([(1, True), (1, False), (2, True)], "event_id long, matched boolean")
    s = matching.run_scores(judged, runs_).first()
    assert (s.recall, s.precision, s.mean_latency_s, s.n_runnable) == (0.5, 0.5, 3.0, 2)


def test_pins(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    pins = spark.createDataFrame([("a",), ("z",)], "item_id string")
    assert {r.item_id: r.status for r in catalogue.pin_exact(pins, items).collect()} == {"a": "found", "z": "missing"}
    with pytest.raises(Exception, match="pinned item missing: z"):
        catalogue.pin_exact(pins, items, strict=True).collect()


def test_spectrum_lines(spark):
    ok = grids.parse_spectrum(spark.createDataFrame([("  1   2137.5 -3e-4 extra",), ("",)], "value string")).collect()
    assert [tuple(r) for r in ok] == [(1, 2137.5, -3e-4)]
    with pytest.raises(Exception, match="needs 3 columns"):
        grids.parse_spectrum(spark.createDataFrame([("1 2137.5",)], "value string")).collect()


def test_binary_grid_round_trip(spark, tmp_path):
    cube = np.random.default_rng(0).normal(30, 5, size=(366, 31, 31)).astype("<f4")
    cube[0, 0, 0] = 99.9
    (tmp_path / "maxtemp_2020.grd").write_bytes(cube.tobytes())
    df = grids.read_daily_grid(spark, str(tmp_path / "*.grd"))
    assert df.count() == cube.size and df.where("tmax is null").count() == 1
    r = df.where("day = date'2020-12-31' and lat = 37.5 and lon = 97.5").first()
    assert r.tmax == pytest.approx(float(cube[-1, -1, -1]))
    (tmp_path / "short_2020.grd").write_bytes(cube[:-1].tobytes())
    with pytest.raises(Exception, match="expected"):
        grids.read_daily_grid(spark, str(tmp_path / "short_2020.grd")).count()


def test_station_rows(spark):
    base = dt.datetime(2022, 4, 2, 6)
    rows = [("s", base.replace(hour=h), t) for h, t in ((6, "+0300,1"), (7, "+0410,1"), (8, "+0410,5"), (9, "+9999,1"), (10, "-0050,0"), (11, "+0990,1"), (12, "x,1"), (13, "+0200,3"), (14, "+0500,1"))]
    obs = spark.createDataFrame(rows, "station string, ts timestamp_ntz, tmp string")
    t = stations.parse_temps(obs)
    assert sorted(r.temp_c for r in t.collect()) == [-5.0, 30.0, 41.0, 41.0, 50.0]
    d = stations.daily_max(t).collect()
    assert [(r.tmax_c, r.n_obs, r.hour_of_max) for r in d] == [(41.0, 4, 7)]
    assert stations.daily_max(t, min_obs=5).count() == 0


def test_station_csv_skips_bad_rows(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("s1", "DATE,TMP,event_id"), ("s1", "2022-04-02T06:00:00,\"+0300,1\",1"), ("s1", "nonsense"), ("s1", "bad-date,\"+0300,1\",2")], "station string, value string").coalesce(1).write.partitionBy("station").text(path)
    got = stations.parse_temps(stations.read_station_csv(spark, path)).collect()
    assert [(r.station, r.temp_c) for r in got] == [("s1", 30.0)]


def test_dedupe_keeps_latest_stamp(spark):
    i = spark.createDataFrame([("P.A2022097.h24v06.061.10",), ("P.A2022097.h24v06.061.20",), ("P.A2022098.h24v06.061.05",)], "item_id string")
    assert sorted(r.item_id for r in catalogue.dedupe_latest(i).collect()) == ["P.A2022097.h24v06.061.20", "P.A2022098.h24v06.061.05"]


def test_lst_quality(spark):
    df = spark.createDataFrame([(15000, 0), (15000, 4), (15000, 1), (0, 0)], "raw long, qc long")
    assert [r[0] for r in df.select(surface.masked_lst(F.col("raw"), F.col("qc"))).collect()] == [300.0, 300.0, None, None]


def test_urban_contrast_needs_enough_cells(spark):
    rows = [(1, 30.0, 0.9, 0.0, 5.0)] * 9 + [(1, 20.0, 0.0, 0.0, 30.0)] * 40
    c = spark.createDataFrame(rows, "day long, lst double, built double, waterwet double, dist_km double").selectExpr("*", "0.5D urban_frac", "20D ring0", "40D ring1")
    assert surface.urban_contrast(c, ["day"]).first().uhi_k is None
    more = c.unionByName(c.where("built > 0.5").limit(1))
    assert surface.urban_contrast(more, ["day"]).first().uhi_k == 10.0


def test_rules_report_each_breach(spark):
    d = spark.createDataFrame([(1, 0.5, 1), (2, None, 1), (3, 2.0, 0)], "id long, score double, n_diagnostics int").selectExpr("*", "'x' role", "'y' factor_name", "false external")
    v = quality.violations(d, "factor", "id", quality.factor_rules()).collect()
    assert sorted((r.key, r.rule) for r in v) == [("2", "score range"), ("3", "at least one diagnostic"), ("3", "score range")]


@pytest.mark.parametrize("want,got,path,kind", [
    ('{"a":{"b":1,"c":[1,2]},"d":null}', '{"d":null,"a":{"c":[1,3],"b":1}}', "$.a.c[1]", "value"),
    ('{"a":1}', '{"a":"1"}', "$.a", "type"), ('{"a":{}}', "{}", "$.a", "missing in got"), ("{}", '{"a":[]}', "$.a", "missing in expected"),
    ('{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":{"e":2}}}}}', "$.a.b.c.d.e", "value"), ("[1,2]", "[1]", "$", "length"),
    ('{"a":[{"x":1,"y":2}]}', '{"a":[{"y":2,"x":1}]}', None, None), ("[]", "{}", "$", "type"), ("1", "1.5", "$", "type"), ("1.50", "1.5", None, None),
    ('{"a":10000000000000000000001}', '{"a":10000000000000000000002}', "$.a", "value"), ('{"a":10000000000000000000001}', '{"a":1e22}', "$.a", "type"),
    ('{"a.b":{"c":1},"a":{"b.c":2}}', '{"a":{"b.c":2},"a.b":{"c":1}}', None, None), ("true", "1", "$", "type"), ("{", "{}", "$", "type"), ("{", "[", None, None),
    ('{"a":NaN}', '{"a":1}', "$", "type"), ("1e400", "1e400", None, None), (None, "null", "$", "type"), ("[" * 5000, "[]", "$", "type"),
    ('{"a":[[[{"k":true}]]]}', '{"a":[[[{"k":false}]]]}', "$.a[0][0][0].k", "value"), ('{"a":null}', '{"a":0}', "$.a", "type"),
])
def test_json_difference_points_at_the_path(spark, want, got, path, kind):
    a = spark.createDataFrame([(1, want), (2, '{"a":1}')], "k long, doc string")
    b = spark.createDataFrame([(1, got), (2, '{"a":1}')], "k long, doc string")
    rows = [(r.k, r.path, r.kind) for r in audit.first_difference(a, b, "k", "doc").collect()]
    assert rows == ([(1, path, kind)] if path else [])


def test_scene_of_one_product_keeps_a_status(spark):
    own = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 2.0), (4, 0, 0, 1.0), (4, 0, 1, 1.0)], "scene_id long, r long, c long, value double")
    ref = spark.createDataFrame([(1, 0, 0, 3.0), (3, 0, 0, 4.0), (4, 0, 0, 5.0)], "scene_id long, r long, c long, value double")
    got = sorted((r.scene_id, r.own, r.ref, r.status) for r in raster.pair_rasters(own, ref).collect())
    assert got == [(1, 1.0, 3.0, "ok"), (2, 2.0, None, "no reference scene"), (3, None, 4.0, "no own scene"), (4, 1.0, 5.0, "grid mismatch")]


def test_geodesic_of_nearly_opposite_points():
    d, az = geodesic_inverse(*(np.array(x, float) for x in ([0, 0], [0, 10], [179.7, 0], [0.5, 10])))
    assert d[0] == pytest.approx(19944127.42, abs=0.01) and d[1] == pytest.approx(0.0, abs=1e-6) and az[0] == pytest.approx(15.556883, abs=1e-5)


def test_factor_ladder_and_ranks(spark):
    d = spark.createDataFrame([(1, 0.967, 7, 10, 0.433, 0.5, 0.4, 2.9, 0.55, -0.77)],
                              "event_id long, ridge_pct double, days_above int, n_days int, ant_pct double, win_pct double, flow_anomaly double, flow_speed double, dew_pct double, uhi_k double")
    got = {r.factor: r for r in attribution.factor_scores(d).collect()}
    assert got["F1"].score == pytest.approx(0.8602) and got["F1"].tier == "MODERATE" and got["F1"].rank == 1
    assert got["F2"].score == pytest.approx(0.0938) and got["F3"].score == pytest.approx(0.138) and got["F3"].rank == 2
    assert got["F4"].tier == "INSUFFICIENT" and got["F5"].score == 0.0 and got["F5"].rank == 5


def test_missing_overlap_is_a_status(spark):
    ev = spark.createDataFrame([(1, 2001, d, 5.0) for d in range(3)], "region_id long, year long, day_idx long, v double")
    cl = spark.createDataFrame([(1, 1999, d, 4.0) for d in range(3)], "region_id long, year long, day_idx long, v double")
    r = attribution.factor_diagnostics(ev, cl, "region_id", 2001, [1999]).first()
    assert r.status == "no overlap years" and r.anomaly is None


def test_fixed_decimals_follow_the_binary_value(spark):
    from skyledger.functions import scoring

    xs = [1.15, 1.25, 1.35, 1.45, 2.5, 0.125, 0.375, 0.015, 0.005, 0.995, 0.9999, 9.95, -1.15, -0.004, -0.0, 0.0, 123456789.05, 2.0**51 + 0.25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", scoring.fixed(F.col("x"), 1).alias("a"), scoring.fixed(F.col("x"), 2).alias("b"), scoring.rate_display(F.col("x")).alias("c")).collect()
    for r in got:
        assert (r.a, r.b) == (f"{r.x:.1f}", f"{r.x:.2f}")
        assert r.c == (r.b if abs(r.x) < 1 else r.a)


def test_longitudes_past_greenwich_stay_on_the_grid(spark):
    from skyledger.functions import geo
    from skyledger.operators import raster

    df = spark.createDataFrame([(-10.08,), (-0.02,), (0.0,), (5.0,), (65.04,)], "lon double")
    got = [r[0] for r in df.select(raster.nearest_index(geo.normalise_lon(F.col("lon"), -10.0, 350.0), 350.0, 0.25)).collect()]
    assert got == [0, 40, 40, 60, 300]


def test_upwind_cells_do_not_depend_on_the_meridian(spark):
    from skyledger.operators import plume

    cells = [(i, west + c * 0.01, 39.0 - r * 0.01) for i, west in enumerate((53.0, 253.05, 653.3, 3653.7)) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(cells, "scene_id long, lon double, lat double")
    wind = df.select("scene_id", F.lit(0.0).alias("u"), F.lit(-1.5).alias("v")).distinct()
    across = df.select("scene_id", F.lit(2.0).alias("u"), F.lit(0.0).alias("v")).distinct()
    for w in (wind, across):
        assert {r.n_top for r in plume.upwind_source(df, w).collect()} == {20}


def test_search_ends_and_pins_list_no_hits(spark):
    items = [(f"i{n:02d}", n % 2 * 1.0, 0.0, n % 2 * 1.0 + 1.5, 1.5, dt.date(2022, 1, 1 + n % 3), dt.date(2022, 1, 9)) for n in range(30)]
    df = spark.createDataFrame(items, "item_id string, min_lon double, min_lat double, max_lon double, max_lat double, t0 date, t1 date")
    df = df.withColumn("cells", catalogue.box_cells(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")))
    asked = [(q, q * 0.5, 0.5, dt.date(2022, 1, 1), dt.date(2022, 1, 1 + q % 3)) for q in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, lon double, lat double, d0 date, d1 date")
    hits = {}
    for r in catalogue.search(df, queries).collect():
        hits.setdefault(r.query_id, []).append((r.t0, r.item_id))
    got = {r.query_id: (r["first"], r["last"]) for r in catalogue.search_ends(df, queries).collect()}
    assert got == {q: (min(h)[1], max(i for _, i in h)) for q, h in hits.items()} and len(got) > 3
    pins = spark.createDataFrame([(q, "i05") for q in range(6)], "query_id long, pin string")
    want = {q for q, h in hits.items() if "i05" in {i for _, i in h}}
    assert {r.query_id for r in catalogue.found_pins(df, queries, pins).collect()} == want


def test_factors_of_an_event_are_ranked_inside_its_row(spark):
    kinds = "event_id long, ridge_pct double, days_above int, n_days int, ant_pct double, win_pct double, flow_anomaly double, flow_speed double, dew_pct double, uhi_k double"
    d = spark.createDataFrame([(1, 0.5, 5, 10, 0.0, 0.0, 0.5, 1.0, 0.5, 0.0), (2, None, None, 10, 0.25, None, 2.0, None, None, 0.0)], kinds)
    ladder = attribution.factor_ladder(d)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (attribution.factor_scores(d), attribution.discrimination(ladder))]
    assert not [p for p in plans if "Exchange" in p or "Sort" in p]
    got = sorted((r.event_id, r.rank, r.factor, r.score, r.tier) for r in attribution.factor_scores(d).collect())
    # Equal scores keep the order of the factors; a missing part counts for nothing.
    assert got[:3] == [(1, 1, "F2", 1.0, "MODERATE"), (1, 2, "F1", 0.5, "MODERATE"), (1, 3, "F3", 0.5, "MODERATE")]
    assert [x[1:] for x in got[5:8]] == [(1, "F1", 1.0, "INSUFFICIENT"), (2, "F3", 1.0, "INSUFFICIENT"), (3, "F2", 0.35, "LOW")]
    assert attribution.discrimination(ladder).where("event_id = 1").first()[1:] == ("F2", "F1", 0.5, False)


def test_inventories_meet_in_one_exchange(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), (None, 1), ("z", None)], "path string, part long")
    b = spark.createDataFrame([("y", 1), ("w", 2), (None, 1)], "path string, part long")
    got = audit.missing_both_ways(a, b, ["path", "part"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = [("None", "1", "left only"), ("None", "1", "right only"), ("w", "2", "right only"), ("x", "1", "left only"), ("z", "None", "left only")]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    assert audit.missing_both_ways(a, b, ["path", "part"], rows=1).rdd.getNumPartitions() == 8


def test_equal_places_and_shapes_are_tested_once(spark, monkeypatch):
    ring = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))]
    polys = spark.createDataFrame([(k, [ring]) for k in range(6)], "poly_id long, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(i, (1.0, 3.0, -0.0, 0.0)[i % 4], 1.0) for i in range(20)], "point_id long, lon double, lat double")
    seen, plain = [], spatial.places_in_shapes
    monkeypatch.setattr(spatial, "places_in_shapes", lambda a, b, *more: (seen.append((a.count(), b.count())), plain(a, b, *more))[1])
    got = sorted(map(tuple, spatial.points_in_polygons(pts, polys, 2.0).collect()))
    assert got == [(i, k) for i in range(20) if i % 4 != 1 for k in range(6)] and seen == [(3, 1)]


def test_tasks_of_the_grid_follow_its_rows(spark, monkeypatch):
    from skyledger import session
    from skyledger.operators import climate
    from skyledger.workload import fixtures as X
    from skyledger.workload.q_heat import _cells

    sf = "/root/testdata/sf0.001"
    least = spark.sparkContext.defaultParallelism
    assert [session.tasks_for(spark.range(1000), n) for n in (1000, 10)] == [least, 100]
    monkeypatch.setattr(X, "tasks_for", lambda df: session.tasks_for(df, 100))
    n = X.grid_tasks(spark, sf)
    days = X.v_days(spark, sf)
    assert n == -(-X.table(spark, sf, "lineitem").count() // 100) and days.rdd.getNumPartitions() == n
    # Cells are not exchanged again for the sums and windows of the climatology.
    clim = climate.window_climatology(days, X.EVENT_YEAR, [("central", 1995, 2000, 10)])
    assert clim.rdd.getNumPartitions() == n
    land = X.v_land(spark, sf)
    few, many = (climate.lane_days(_cells(spark, sf), land, t).select("region_id", "day_idx", "extent_km2", "area_frac") for t in (None, n))
    values = lambda d: sorted((r[0], r[1], round(r[2], 3), round(r[3], 9)) for r in d.collect())
    assert values(few) == values(many)
