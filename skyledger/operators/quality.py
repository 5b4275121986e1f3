"""Constraint checks that return violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: entity, key and rule name.

    A rule holds when its condition is true; a NULL condition breaks it. All
    rules are tested in one pass over the table.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def optional(cond: Column, *present: Column) -> Column:
    """A rule that only applies where the given fields are present."""
    absent = present[0].isNull()
    for p in present[1:]:
        absent = absent | p.isNull()
    return absent | cond


def detection_rules() -> dict[str, Column]:
    c = F.col
    return {
        "anomaly needs baseline": ~c("is_anomaly") | c("baseline").isNotNull(),
        "anomaly needs footprint": ~c("is_anomaly") | c("footprint").isNotNull(),
        "longitude range": c("lon").between(-180.0, 180.0),
        "latitude range": c("lat").between(-90.0, 90.0),
        "end before start": optional(c("t1") >= c("t0"), c("t1")),
        "confidence range": c("confidence").between(0.0, 1.0),
    }


def event_rules() -> dict[str, Column]:
    c = F.col
    return {
        "bbox order": (c("e_box.min_lon") <= c("e_box.max_lon")) & (c("e_box.min_lat") <= c("e_box.max_lat")),
        "location inside bbox": c("e_lon").between(c("e_box.min_lon"), c("e_box.max_lon")) & c("e_lat").between(c("e_box.min_lat"), c("e_box.max_lat")),
        "end before start": optional(c("e_t1") >= c("e_t0"), c("e_t1")),
        "at least one reference": c("n_references") >= 1,
        "precision positive": optional(c("precision_km") > 0, c("precision_km")),
    }


def baseline_rules() -> dict[str, Column]:
    c = F.col
    return {
        "period order": c("period_end") >= c("period_start"),
        "percentile needs value": (c("statistic") != "percentile") | c("percentile").isNotNull(),
        "percentile range": optional(c("percentile").between(0.0, 100.0), c("percentile")),
        "window not negative": c("window_days") >= 0,
    }


def reference_rules() -> dict[str, Column]:
    return {"reason required": (F.col("usability") == "comparable") | (F.coalesce(F.trim("why"), F.lit("")) != "")}


def factor_rules() -> dict[str, Column]:
    return {
        "at least one diagnostic": F.col("n_diagnostics") >= 1,
        "score range": F.col("score").between(0.0, 1.0),
        "urban never a contributor": ~((F.col("role") == "warming_contributor") & F.contains(F.lower("factor_name"), F.lit("urban"))),
        "external attribution unscored": ~(F.col("external") & (F.col("score") > 0)),
    }
