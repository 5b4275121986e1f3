"""Catalogue, event detail, tiers, caveats and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def event_catalogue(events: DataFrame, plume: DataFrame, heat: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every event with its status: active with a result and render bounds, else pending.

    Plume events sit on the computed centroid, others on the benchmark position.
    """
    j = (
        events.join(plume.select("event_id", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), "rate"), "event_id", "left")
        .join(heat.select("event_id", "anomaly", "peak"), "event_id", "left")
        .join(bounds.select("event_id").distinct().withColumn("has_bounds", F.lit(True)), "event_id", "left")
    )
    result = F.col("rate").isNotNull() | F.col("anomaly").isNotNull()
    active = result & F.coalesce("has_bounds", F.lit(False))
    is_heat = F.col("phenomenon") == "heat_wave"
    headline = (
        F.when(~active, "pending")
        .when(is_heat, F.format_string("T2M +%.1f K, peak %.1f C", "anomaly", "peak"))
        .otherwise(F.concat(F.lit("CH4 "), S.rate_display(F.col("rate")), F.lit(" t/hr")))
    )
    moved = active & ~is_heat
    return j.select(
        "event_id", "name", F.when(active, "active").otherwise("pending").alias("status"),
        F.when(moved, F.coalesce("p_lon", "e_lon")).otherwise(F.col("e_lon")).alias("lon"),
        F.when(moved, F.coalesce("p_lat", "e_lat")).otherwise(F.col("e_lat")).alias("lat"), headline.alias("headline"),
    )


def quantity_tiers(checks: DataFrame) -> DataFrame:
    """Tier per heat quantity from the validation flags of each event.

    ``checks``: ``event_id, v1, v3a, v3b`` (booleans). Quantities without an
    independent truth keep a fixed tier.
    """
    row = lambda q, lane, tier: F.struct(F.lit(q).alias("quantity"), F.lit(lane).alias("lane"), tier.alias("tier"))
    pick = lambda c: F.when(c, "VALIDATED").otherwise("NOT VALIDATED")
    rows = F.array(
        row("C1", "AIR", pick(F.col("v1"))), row("C2", "AIR", pick(F.col("v3a") & F.col("v3b"))),
        row("C3", "AIR", F.lit("NOT VALIDATED")), row("C4", "AIR", F.lit("NOT VALIDATED")),
        row("V2", "AIR", F.lit("CONSISTENCY NOT CLAIMED")),
        row("LST", "LST", F.lit("CROSS-CHECKED (ceiling)")), row("UHI", "LST", F.lit("CROSS-CHECKED (ceiling)")),
    )
    return checks.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.*")


def scope_caveats(refs: DataFrame) -> DataFrame:
    """Share of a cluster total where the reference is one, else context only."""
    cluster = F.col("uncertainty").isNotNull() & (F.coalesce("n_sources", F.lit(0)) > 0)
    return refs.select(
        "event_id", F.when(cluster, "cluster_fraction").otherwise("context_only").alias("kind"),
        F.when(cluster, F.col("calibrated") / F.col("total") * 100.0).alias("fraction_low_pct"),
        F.when(cluster, F.col("own") / F.col("total") * 100.0).alias("fraction_high_pct"),
    )


def event_detail(results: DataFrame) -> DataFrame:
    """Both calibrations with ranges and the uncertainty budget, one row per budget term.

    ``results``: ``event_id, q, q_cal, low, high, bias, sigma, alpha1, u10, spread``.
    """
    total = F.col("sigma") * 100.0
    term = lambda k, v: F.struct(F.lit(k).alias("term"), v.alias("pct"), F.when(v.isNotNull() & (total > 0), F.least(F.lit(1.0), v / total)).alias("share"))
    budget = F.array(
        term("alpha1", F.col("alpha1") * 100.0), term("u10", F.col("u10") * 100.0), term("mask", F.col("spread") / 2.0 * 100.0),
        F.struct(F.lit("mf_amplitude").alias("term"), F.lit(None).cast("double").alias("pct"), F.lit(1.0).alias("share")),
    )
    return results.select(
        "event_id", "q", "q_cal", "low", "high", (F.col("low") / F.col("bias")).alias("cal_low"), (F.col("high") / F.col("bias")).alias("cal_high"),
        F.when(F.col("bias") >= 1.0, "over").otherwise("under").alias("amplitude"), F.explode(budget).alias("b"),
    ).select("*", "b.*").drop("b")


def key_figures(results: DataFrame, key: str, specs: dict[str, str], source: str) -> DataFrame:
    """Long table of named figures with a display text and a pointer to the source field."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("figure"), F.col(name).cast("double").alias("value"),
                F.format_string(fmt, F.col(name).cast("double")).alias("display"),
                F.concat(F.lit(source + "/"), F.col(key).cast("string"), F.lit("#" + name)).alias("source"),
            )
            for name, fmt in specs.items()
        ]
    )
    return results.select(key, F.explode(rows).alias("f")).select(key, "f.*")
