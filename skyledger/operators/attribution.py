"""Weighted hypotheses for sources and contributing factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scoring as S

# Component values of the field-level hypotheses (spatial, type, magnitude).
FIELD_VALUES = {
    "H1": (0.85, 0.90, 0.90),
    "H2": (0.30, 0.90, 0.90),
    "H3": (0.50, 0.15, 0.40),
}
FIELD_NOT_CONTAINED = 0.5
# Component values of the facility-level hypotheses.
FACILITY_VALUES = {
    "H1": (0.50, 0.85, 0.80),
    "H2": (0.30, 0.85, 0.80),
    "H3": (0.50, 0.08, 0.30),
}
WEIGHTS = (C.WEIGHT_SPATIAL, C.WEIGHT_TYPE, C.WEIGHT_MAGNITUDE)
COMPONENTS = ("spatial_consistency", "type_prior", "magnitude_consistency")


def score_components(components: DataFrame, keys: list[str], edges, ceiling: str, digits: int = 4) -> DataFrame:
    """Score, tier and the ordered component list per hypothesis.

    ``components``: keys, ``component``, ``value``, ``weight``. Component lists
    are short by nature (a handful per hypothesis).
    """
    g = components.groupBy(*keys).agg(
        F.bround(F.sum(F.col("value") * F.col("weight")), digits).alias("score"),
        F.array_sort(
            F.collect_list(F.struct("component", "value", "weight", S.contribution(F.col("value"), F.col("weight")).alias("contribution")))
        ).alias("components"),
    )
    t = S.capped_band(F.col("score"), edges, ceiling)
    return g.withColumn("_t", t).select("*", "_t.tier", "_t.capped").drop("_t")


def _hypothesis_rows(events: DataFrame, values: dict, spatial_override: Column | None) -> DataFrame:
    rows = []
    for rank, (hyp, vals) in enumerate(values.items(), start=1):
        for name, v, w in zip(COMPONENTS, vals, WEIGHTS, strict=True):
            value = F.lit(float(v))
            if hyp == "H1" and name == "spatial_consistency" and spatial_override is not None:
                value = spatial_override
            rows.append(
                F.struct(F.lit(hyp).alias("hyp"), F.lit(rank).alias("rank"), F.lit(name).alias("component"),
                         value.alias("value"), F.lit(float(w)).alias("weight"))
            )
    return events.select("event_id", F.explode(F.array(*rows)).alias("c")).select("event_id", "c.*")


def field_hypotheses(sources: DataFrame) -> DataFrame:
    """Three field-level hypotheses per source; ``contained`` tells if it lies in the named field."""
    spatial = F.when(F.col("contained"), FIELD_VALUES["H1"][0]).otherwise(FIELD_NOT_CONTAINED)
    rows = _hypothesis_rows(sources, FIELD_VALUES, spatial)
    return score_components(rows, ["event_id", "hyp", "rank"], S.SOURCE_EDGES, "MODERATE")


def facility_hypotheses(events: DataFrame) -> DataFrame:
    """Three facility-level hypotheses per event with candidates, capped at LOW."""
    rows = _hypothesis_rows(events, FACILITY_VALUES, None)
    return score_components(rows, ["event_id", "hyp", "rank"], S.SOURCE_EDGES, "LOW")


def facility_summary(ranked: DataFrame) -> DataFrame:
    """Best-aligned and nearest candidate, shared pad size and counts per event.

    ``ranked`` comes from ``rank_candidates`` with ``name`` and ``operator``.
    """
    lease = F.trim(F.substring_index("name", " #", 1))
    r = ranked.withColumn("lease", lease)
    top = r.where("rank = 1").select(
        "event_id", F.col("feature_id").alias("top_id"), F.col("lease").alias("top_lease"), F.col("operator").alias("top_operator"),
        F.col("dev_deg").alias("top_dev"), F.col("dist_km").alias("top_km"), "n_2s", "n_1s",
    )
    near = r.groupBy("event_id").agg(
        F.min_by(F.struct("feature_id", "dist_km"), F.struct("dist_km", "feature_id")).alias("n")
    ).select("event_id", F.col("n.feature_id").alias("near_id"), F.col("n.dist_km").alias("near_km"))
    pads = r.groupBy("event_id", F.col("lease").alias("top_lease"), F.col("operator").alias("top_operator")).agg(F.count("*").alias("n_pad"))
    return top.join(pads, ["event_id", "top_lease", "top_operator"]).join(near, "event_id")


def alternatives(ranked: DataFrame, summary: DataFrame, cap: int = C.RENDER_CAP) -> DataFrame:
    """First ``cap`` candidates off the leading pad, with the number of all of them."""
    lease = F.trim(F.substring_index("name", " #", 1))
    s = summary.select("event_id", "top_lease", "top_operator", "n_pad")
    other = ranked.withColumn("lease", lease).join(s, "event_id").where(
        ~((F.col("lease") == F.col("top_lease")) & (F.col("operator") == F.col("top_operator")))
    )
    n = other.groupBy("event_id").agg(F.count("*").alias("n_other"))
    # The last one wanted cannot lie deeper than the whole leading pad before it.
    near = other.where(F.col("rank") <= cap + F.col("n_pad"))
    alt = F.row_number().over(W.partitionBy("event_id").orderBy("rank")).cast("bigint")
    first = near.select("event_id", "feature_id", alt.alias("alt")).where(F.col("alt") <= cap)
    return first.join(n, "event_id").select("event_id", "n_other", "alt", "feature_id")


def window_means(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Window mean of daily area-weighted regional means per year."""
    d = daily.groupBy(*keys, "year", "day_idx").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("v"))
    return d


def factor_diagnostics(event_daily: DataFrame, clim_daily: DataFrame, key: str, event_year: int, overlap: list[int]) -> DataFrame:
    """Event window against a climatology from another product, cross-product offset removed.

    Both inputs are daily regional means ``(key, year, day_idx, v)``. No overlap
    year gives a status instead of numbers. A climatology has one row per year
    and day of the window, so its exact percentile is bounded.
    """
    wm = lambda d: d.groupBy(key, "year").agg(F.avg("v").alias("m"))
    clim_years = wm(clim_daily)
    ev = wm(event_daily.where(F.col("year") == event_year)).select(key, F.col("m").alias("event_mean"))
    off = (
        wm(event_daily.where(F.col("year").isin(*overlap))).withColumnRenamed("m", "a").join(clim_years, [key, "year"])
        .groupBy(key).agg(F.avg(F.col("a") - F.col("m")).alias("offset"), F.count("*").alias("n_overlap"))
    )
    base = clim_years.groupBy(key).agg(F.avg("m").alias("clim_mean"), F.stddev_pop("m").alias("clim_std"))
    p90 = clim_daily.groupBy(key).agg(F.percentile("v", F.lit(0.9)).alias("p90"))
    j = ev.join(off, key, "left").join(base, key).join(p90, key).withColumn("corrected", F.col("event_mean") - F.col("offset"))
    pct = clim_years.join(j.select(key, "corrected"), key).groupBy(key).agg(percent_rank(F.col("m"), F.col("corrected")).alias("percentile"))
    pooled = clim_daily.join(j.select(key, "corrected"), key).groupBy(key).agg(
        percent_rank(F.col("v"), F.col("corrected")).alias("pooled_percentile"))
    days = event_daily.where(F.col("year") == event_year).join(j.select(key, "p90", "offset"), key).groupBy(key).agg(
        F.count(F.when(F.col("v") > F.col("p90") + F.col("offset"), 1)).alias("days_above"), F.count("*").alias("n_days"))
    return j.join(pct, key).join(pooled, key).join(days, key).withColumn("anomaly", F.col("corrected") - F.col("clim_mean")).withColumn(
        "status", F.when(F.col("n_overlap").isNull(), "no overlap years").otherwise("ok"))


def percent_rank(sample: Column, value: Column) -> Column:
    """Aggregate: share of samples strictly below a value; NULL without samples."""
    return F.avg((sample < value).cast("double"))


# The components of each factor and their weights.
FACTORS = {
    "F1": ("warming_contributor", {"ridge_anomaly_percentile": 0.6, "ridge_persistence": 0.4}),
    "F2": ("warming_contributor", {"antecedent_dryness_rarity": 0.7, "window_dryness_rarity": 0.3}),
    "F3": ("warming_contributor", {"flow_anomaly_magnitude": 1.0}),
    "F4": ("severity_framing", {"humidity_anomaly_rarity": 1.0}),
    "F5": ("counter_evidence", {"urban_contrast": 1.0}),
}


def factor_ladder(diag: DataFrame) -> DataFrame:
    """``event_id`` and ``factors`` of every row of ``diag``: an array of (rank, factor, role, score, raw) by rank; ``_humid`` is its humidity rarity.

    ``diag``: ``event_id, ridge_pct, days_above, n_days, ant_pct, win_pct,
    flow_anomaly, flow_speed, dew_pct, uhi_k``, one row per event. An event's five factors are
    made and ranked inside its row, so no row is moved: contributors by falling score, equal ones
    in their order, then the others. A missing component counts for nothing.
    """
    ant, win = 1.0 - F.col("ant_pct"), 1.0 - F.col("win_pct")
    values = {
        "ridge_anomaly_percentile": F.col("ridge_pct"), "ridge_persistence": F.col("days_above") / F.col("n_days"),
        "antecedent_dryness_rarity": S.rarity_above_median(ant), "window_dryness_rarity": S.rarity_above_median(win),
        "flow_anomaly_magnitude": S.flow_anomaly_ratio(F.col("flow_anomaly"), F.col("flow_speed")),
        "humidity_anomaly_rarity": F.col("_humid"), "urban_contrast": F.lit(0.0),
    }
    shares = {c: S.contribution(F.bround(values[c], 3), F.lit(w)).alias(f"_{c}") for _, parts in FACTORS.values() for c, w in parts.items()}
    d = diag.withColumn("_humid", S.rarity_two_sided(1.0 - F.col("dew_pct"))).select("event_id", "_humid", *shares.values())

    def total(parts: dict[str, float]) -> Column:
        known = F.coalesce(*[F.col(f"_{c}") for c in parts]).isNotNull()
        return F.when(known, F.bround(sum((F.coalesce(f"_{c}", F.lit(0.0)) for c in parts), F.lit(0.0)), 4))

    d = d.select("event_id", "_humid", *[total(parts).alias(f) for f, (_, parts) in FACTORS.items()])
    d = d.select("*", *[F.least(f, F.lit(1.0)).alias(f"_{f}") for f in FACTORS])
    lead = [f for f, (role, _) in FACTORS.items() if role == "warming_contributor"]

    def before(a: str, b: str) -> Column:
        x, y = F.col(f"_{a}"), F.col(f"_{b}")
        return F.coalesce(x > y, x.isNull() & y.isNotNull()) | (x.eqNullSafe(y) & F.lit(a < b))

    def row(place: int, factor: str) -> Column:
        rank = F.lit(place)
        if factor in lead:
            rank = sum((before(f, factor).cast("int") for f in lead if f != factor), F.lit(1))
        return F.struct(rank.cast("bigint").alias("rank"), F.lit(factor).alias("factor"), F.lit(FACTORS[factor][0]).alias("role"),
                        F.col(f"_{factor}").alias("score"), F.col(factor).alias("raw"))

    return d.select("event_id", "_humid", F.array_sort(F.array(*[row(i, f) for i, f in enumerate(FACTORS, start=1)])).alias("factors"))


def factor_scores(diag: DataFrame) -> DataFrame:
    """Factor hypotheses from a wide diagnostics table, one row per (event, factor); see :func:`factor_ladder`."""
    # explode would add a test of the array below the steps that make it, and so make it twice.
    s = factor_ladder(diag).select("event_id", "_humid", F.explode_outer("factors").alias("x")).select("event_id", "_humid", "x.*")
    tier = (
        F.when(F.col("factor") == "F4", F.when(F.col("_humid") >= 0.25, "LOW").otherwise("INSUFFICIENT"))
        .when(F.col("factor") == "F5", "INSUFFICIENT").otherwise(S.capped_band(F.col("raw"), S.FACTOR_EDGES, "MODERATE")["tier"])
    )
    return s.select("event_id", "factor", "role", "score", tier.alias("tier"), "rank")


def discrimination(ladder: DataFrame) -> DataFrame:
    """Gap between the two leading contributors of every row of :func:`factor_ladder` and whether it resolves them."""
    g = ladder.select("event_id", F.col("factors")[0].alias("a"), F.col("factors")[1].alias("b"))
    gap = F.abs(F.col("a.score") - F.col("b.score"))
    return g.select("event_id", F.col("a.factor").alias("first"), F.col("b.factor").alias("second"), gap.alias("gap"),
                    (gap < C.DISCRIMINATION_GAP).alias("undiscriminated"))
