"""Exact linear-interpolated percentiles and exact ranks that survive hot groups.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here a bounded sketch brackets each wanted rank first, so
only a sliver of a group is ever ordered, and the result is still exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ACCURACY = 10000
_RANGE_ROWS = 50_000


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probs: dict[str, float],
    accuracy: int = _ACCURACY,
) -> DataFrame:
    """One row per group with one column per entry of ``probs`` plus ``n_values``.

    ``probs`` maps an output column to a probability in [0, 1]. NULL values are
    skipped. Groups without values are absent.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 2.0 / accuracy
    edges: list[float] = []
    for p in probs.values():
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
    )
    if keys:
        joined = rows.join(sketch, keys)
        edge = lambda i: F.get("_edges", F.lit(i))
    else:
        # A whole-table percentile needs only its few bracket values on the driver.
        one = sketch.first()
        found = list(one["_edges"]) if one["_edges"] else [None] * len(edges)
        joined = rows.withColumn("_total", F.lit(one["_total"]).cast("bigint"))
        edge = lambda i: F.lit(found[i]).cast("double")
    bands = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), edge(2 * i).alias("lo"), edge(2 * i + 1).alias("hi"))
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    v, b = F.col("_v"), F.col("_b")
    # Values outside the bracket collapse into one counted row per side, map-side.
    slot = F.when(v < b["lo"], float("-inf")).when(v > b["hi"], float("inf")).otherwise(v)
    counted = (
        joined.select(*keys, "_total", "_v", F.explode(bands).alias("_b"))
        .select(*keys, "_total", "_v", b["name"].alias("_name"), b["p"].alias("_p"), slot.alias("_slot"))
        .groupBy(*keys, "_name", "_p", "_total", "_slot")
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    w = W.partitionBy(*keys, "_name").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_n").over(w)).withColumn(
        "_h", F.col("_p") * (F.col("_total") - 1)
    )

    def at(rank: Column) -> Column:
        inside = (rank > F.col("_cum") - F.col("_n")) & (rank <= F.col("_cum"))
        return F.max(F.when(inside, F.when(F.col("_slot") == float("-inf"), F.col("_max")).otherwise(F.col("_min"))))

    one = ranked.groupBy(*keys, "_name", "_total", "_h").agg(
        at(F.floor("_h") + 1).alias("_lo"), at(F.ceil("_h") + 1).alias("_hi")
    )
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return one.groupBy(*keys).agg(
        F.max("_total").alias("n_values"),
        *[F.max(F.when(F.col("_name") == name, point)).alias(name) for name in probs],
    )


def exact_row_number(
    df: DataFrame, keys: list[str], order: list[Column], lead: Column, out: str, splits: int | None = None
) -> DataFrame:
    """Row number per group in the order ``order``, without one task per group.

    ``lead`` is the first ordering key as an ascending double. Groups are cut
    into ``splits`` value ranges, by default so many that a range of the largest
    group holds about ``_RANGE_ROWS`` rows; numbering runs inside a range and is
    shifted by the rows of the ranges before it.
    """
    if splits is None:
        most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        splits = max(2, -(-most // _RANGE_ROWS))
    probs = [i / splits for i in range(1, splits)]
    rows = df.withColumn("_lead", lead.cast("double"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_lead", probs, 1000).alias("_cuts"))
    v = F.col("_lead")
    part = F.size(F.filter("_cuts", lambda c: c < v))
    tagged = rows.join(cuts, keys).withColumn("_part", part).drop("_cuts")
    w = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .drop("_n")
    )
    inner = W.partitionBy(*keys, "_part").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "_part"])
        .withColumn(out, (F.row_number().over(inner) + F.col("_offset")).cast("bigint"))
        .drop("_lead", "_part", "_offset")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: Column, first: bool = False) -> DataFrame:
    """One whole row per key with the greatest (or smallest) ``order``.

    An aggregate rather than a ranked window, so a hot key is reduced map-side.
    """
    pick = F.min_by if first else F.max_by
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(row, order).alias("_r")).select(*keys, "_r.*")
