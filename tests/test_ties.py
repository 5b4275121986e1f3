"""Ties that must not hang on the last bits of a sum."""

import math

from skyledger.workload import q_heat


def test_duration_extent_takes_the_first_of_equal_peaks(spark, sf, monkeypatch):
    # The same cells are hot on days 20 and 60; summed in another order they differ in the last bit.
    low = 45_400.0
    high = math.nextafter(low, math.inf)
    days = spark.createDataFrame(
        [(1, d, x, x / 56_800.0) for d, x in [(19, 0.0), (20, low), (21, low / 2), (59, 0.0), (60, high), (61, 0.0)]],
        "region_id long, day_idx long, extent_km2 double, area_frac double",
    )
    assert low / 56_800.0 < high / 56_800.0
    monkeypatch.setattr(q_heat, "_days", lambda *_: days)
    monkeypatch.setattr(q_heat, "_second_cells", lambda *_: None)
    monkeypatch.setattr(q_heat.climate, "lane_days", lambda *_: days)
    (row,) = q_heat.a29(spark, sf).collect()
    assert (row.peak_day, row.n_own, row.n_other, row.pass_extent) == (20, 2, 2, True)
