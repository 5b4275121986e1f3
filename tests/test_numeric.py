import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import constants as C
from skyledger.functions import geo, identity, scoring
from skyledger.functions.numeric import geodesic_inverse, t_upper_tail_array
from skyledger.operators.percentiles import exact_percentiles, exact_row_number, latest_per_key


def test_t_tail_table_values():
    t = np.array([1.708, 2.086, 12.706, 1.96, 0.0, -1.708])
    df = np.array([25, 20, 1, 1e7, 5, 25])
    want = [0.05, 0.025, 0.025, 0.025, 0.5, 0.95]
    assert np.allclose(t_upper_tail_array(t, df), want, atol=2e-5)


def test_t_tail_symmetry_and_missing():
    t = np.linspace(0, 30, 50)
    up = t_upper_tail_array(t, np.full(50, 7.3))
    down = t_upper_tail_array(-t, np.full(50, 7.3))
    assert np.allclose(up + down, 1.0) and np.all(np.diff(up) < 0)
    assert np.isnan(t_upper_tail_array(np.array([np.nan]), np.array([3.0])))[0]


def test_geodesic_known_lengths():
    d, az = geodesic_inverse(np.array([0.0, 0.0, 179.5]), np.array([0.0, 0.0, 0.0]), np.array([1.0, 0.0, -179.5]), np.array([0.0, 90.0, 0.0]))
    assert d[0] == pytest.approx(111319.49079327357, abs=1e-4) and az[0] == pytest.approx(90.0)
    assert d[1] == pytest.approx(10001965.729, abs=1e-2) and az[1] == pytest.approx(0.0)
    assert d[2] == pytest.approx(111319.49079327357, abs=1e-4)
    d, az = geodesic_inverse(np.array([5.0]), np.array([5.0]), np.array([5.0]), np.array([5.0]))
    assert d[0] == 0.0


def test_name_uuid_matches_the_standard(spark):
    import uuid

    names = ["https://example.org/a", "granule", "ü"]
    got = {r.n: r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.name_uuid(F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_scores_keep_missing_missing(spark):
    r = spark.sql("select cast(null as double) p").select(
        scoring.rarity_above_median(F.col("p")).alias("a"), scoring.rarity_two_sided(F.col("p")).alias("b"),
        scoring.flow_anomaly_ratio(F.col("p"), F.lit(1.0)).alias("c")).first()
    assert tuple(r) == (None, None, None)


def test_missing_box_never_matches(spark):
    r = spark.sql("select cast(null as struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>) a, named_struct('min_lon',0D,'min_lat',0D,'max_lon',1D,'max_lat',1D) b")
    assert r.select(geo.area_overlap_match(F.col("a"), F.col("b"))).first()[0] is False
    assert r.select(geo.area_overlap_match(F.col("b"), F.col("b"))).first()[0] is True


def test_angles(spark):
    r = spark.range(1).select(geo.angular_diff(F.lit(350.0), F.lit(10.0)), geo.angular_diff(F.lit(-170.0), F.lit(170.0)), geo.norm360(F.lit(-10.0))).first()
    assert [round(x, 9) for x in r] == [20.0, 20.0, 350.0]


@pytest.mark.parametrize("accuracy", [10000, 40])
def test_exact_percentiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(size=6000), 2), "one": np.array([4.0]), "two": np.array([1.0, 9.0]), "tie": np.full(500, 7.0), "odd": rng.exponential(size=333)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), probs, accuracy).collect()}
    for k, vs in groups.items():
        assert got[k].n_values == len(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, name)


def test_exact_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x), i) for i, x in enumerate(np.round(rng.normal(size=3000), 1))] + [("b", 1.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = exact_row_number(df, ["k"], [F.col("v"), F.col("id")], F.col("v"), "rn", splits=16)
    want = {r.id: i + 1 for i, r in enumerate(sorted([r for r in df.collect() if r.k == "hot"], key=lambda r: (r.v, r.id)))}
    assert {r.id: r.rn for r in got.where("k = 'hot'").collect()} == want


def test_latest_per_key_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, s int, v string")
    assert sorted((r.k, r.s, r.v) for r in latest_per_key(df, ["k"], F.col("s")).collect()) == [("a", 3, "y"), ("b", 2, None)]


def test_constants_sane():
    assert math.isclose(C.AIR_KG_PER_MOLECULE, 4.8096e-26, rel_tol=1e-4)
