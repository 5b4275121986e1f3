"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``), ``component`` the smallest node reachable.

    Alternates two steps until nothing moves: every node hands its larger neighbours the
    smallest one it knows, then its smaller ones. Both are a minimum per key and an
    equality join, so a node with many neighbours is pre-aggregated, never collected.
    Each round ends with a reliable checkpoint; the driver sees two numbers a round.
    """
    pairs = cut_lineage(_both(edges.select("a", "b").where("a <> b")).distinct())
    last = None
    while True:
        large = _hand_on(pairs, F.col("b") > F.col("a"))
        pairs = cut_lineage(_both(_hand_on(_both(large), F.col("b") < F.col("a"))).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return pairs.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hand_on(pairs: DataFrame, which) -> DataFrame:
    """Link the neighbours on one side of every node with the smallest of its neighbourhood, itself included."""
    lowest = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("k"), "m")
    linked = pairs.where(which).join(lowest, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = lowest.where("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))
    return linked.union(own).where("a <> b").distinct()
