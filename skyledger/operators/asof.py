"""Time-bracket joins with linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Length of the time blocks that neighbours are searched in, in seconds.
BLOCK_S = 30 * 86400


def with_neighbours(rows: DataFrame, keys: list[str], strict: bool, block_s: int = BLOCK_S) -> DataFrame:
    """``rows`` (keys, ``_at``, ``_s``) with ``_before`` and ``_after``: the nearest non-NULL ``_s`` in time.

    ``strict`` leaves out rows of the same time. Windows run inside blocks of time, and
    each block is told the last and first value of the blocks around it, so the rows of
    one key never meet in one task.
    """
    rows = rows.withColumn("_blk", F.floor(F.col("_at") / block_s).cast("bigint"))
    s, at = F.col("_s"), F.col("_at")
    edge = rows.groupBy(*keys, "_blk").agg(
        F.max_by(s, F.when(s.isNotNull(), at)).alias("_l"), F.min_by(s, F.when(s.isNotNull(), at)).alias("_f")
    )
    order = W.partitionBy(*keys).orderBy("_blk")
    edge = edge.select(
        *keys, "_blk",
        F.last("_l", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_carry_l"),
        F.first("_f", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_carry_f"),
    )
    inner = W.partitionBy(*keys, "_blk").orderBy("_at")
    gap = 1 if strict else 0
    out = rows.withColumn("_in_l", F.last("_s", True).over(inner.rangeBetween(W.unboundedPreceding, -gap))).withColumn(
        "_in_f", F.first("_s", True).over(inner.rangeBetween(gap, W.unboundedFollowing))
    )
    return out.join(edge, [*keys, "_blk"]).select(
        *rows.columns, F.coalesce("_in_l", "_carry_l").alias("_before"), F.coalesce("_in_f", "_carry_f").alias("_after")
    ).drop("_blk")


def bracket_interpolate(
    requests: DataFrame, samples: DataFrame, keys: list[str], fields: list[str], reach_s: int = 3600, block_s: int = BLOCK_S
) -> DataFrame:
    """Interpolate ``fields`` linearly at each request time between the samples around it.

    ``requests`` has the keys, ``request_id`` and epoch seconds ``t``; ``samples`` has the
    keys, epoch seconds ``ts`` and the fields. The neighbours count however far they are;
    before the first and after the last sample the line through the two nearest ones goes
    on, and a single sample stands for all times. A request whose nearest sample is
    further than ``reach_s`` keeps its row, with NULL fields and the status ``no sample``.
    """
    point = F.struct("ts", *fields)
    own = with_neighbours(samples.select(*keys, F.col("ts").alias("_at"), point.alias("_s")), keys, True, block_s)
    own = own.select(*keys, "_at", F.struct("_s.*", F.col("_before").alias("_p"), F.col("_after").alias("_n")).alias("_s"))
    asked = requests.select(*keys, F.col("t").alias("_at"), F.struct(*requests.columns).alias("_r"))
    both = own.unionByName(asked, allowMissingColumns=True)
    j = with_neighbours(both, keys, False, block_s).where(F.col("_r").isNotNull()).select("_r.*", "_before", "_after")
    a, b, t = F.col("_before"), F.col("_after"), F.col("t")

    def line(p: Column, q: Column, f: str) -> Column:
        return F.when(q["ts"] > p["ts"], p[f] + (q[f] - p[f]) * ((t - p["ts"]) / (q["ts"] - p["ts"]))).otherwise(p[f])

    def value(f: str) -> Column:
        alone = F.when(a.isNull(), F.when(b["_n"].isNotNull(), line(b, b["_n"], f)).otherwise(b[f])).otherwise(
            F.when(a["_p"].isNotNull(), line(a["_p"], a, f)).otherwise(a[f])
        )
        return F.when(a.isNotNull() & b.isNotNull(), line(a, b, f)).otherwise(alone)

    near_ts = (
        F.when(a.isNull(), b["ts"]).when(b.isNull(), a["ts"])
        .when(t - a["ts"] <= b["ts"] - t, a["ts"]).otherwise(b["ts"])
    )
    ok = F.coalesce(F.abs(near_ts - t) <= reach_s, F.lit(False))
    return j.select(
        *requests.columns, *[F.when(ok, value(f)).alias(f) for f in fields],
        F.when(ok, near_ts).alias("nearest_ts"), F.when(ok, F.abs(near_ts - t) / 3600.0).alias("hour_distance"),
        F.when(ok, "ok").otherwise("no sample").alias("status"),
    )
