"""Archive catalogue: search, pinning, de-duplication and asset maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.percentiles import latest_per_key


def search(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Items whose box holds the query point and whose interval meets the query dates.

    ``items``: ``item_id, min_lon, min_lat, max_lon, max_lat, t0, t1, cells``
    with ``cells`` the one-degree cells the box touches; ``queries``:
    ``query_id, lon, lat, d0, d1``. Items meet queries by cell.
    """
    q = queries.withColumn("_c", F.struct(F.floor("lat").cast("bigint").alias("i"), F.floor("lon").cast("bigint").alias("j")))
    c = items.withColumn("_c", F.explode("cells"))
    return c.join(q, "_c").where(_hit()).select("query_id", "item_id", "t0")


def _hit() -> Column:
    return (
        F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
        & (F.col("t0") <= F.col("d1")) & (F.col("t1") >= F.col("d0"))
    )


def search_ends(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, first, last`` of the items :func:`search` finds: the first by time, then id, and the greatest id.

    Items of one box and interval are found by the same queries, so they meet the queries as
    one row with their smallest and greatest id; the hits themselves are never listed.
    """
    box = ["min_lon", "min_lat", "max_lon", "max_lat", "t0", "t1", "cells"]
    classes = items.groupBy(*box).agg(F.min("item_id").alias("_low"), F.max("item_id").alias("_high"))
    hits = search(classes.withColumn("item_id", F.struct("_low", "_high")), queries)
    ends = hits.groupBy("query_id").agg(F.min(F.struct("t0", "item_id._low")).alias("f"), F.max("item_id._high").alias("last"))
    return ends.select("query_id", F.col("f._low").alias("first"), "last")


def found_pins(items: DataFrame, queries: DataFrame, pins: DataFrame) -> DataFrame:
    """``query_id, item_id`` of the ``pins`` (``query_id, pin``) that :func:`search` finds, looked up by their id."""
    asked = pins.join(queries, "query_id")
    return asked.join(items, F.col("pin") == F.col("item_id")).where(_hit()).select("query_id", "item_id").distinct()


def box_cells(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """One-degree cells a box touches, as (i, j) structs."""
    i = F.sequence(F.floor(min_lat).cast("bigint"), F.floor(max_lat).cast("bigint"))
    j = F.sequence(F.floor(min_lon).cast("bigint"), F.floor(max_lon).cast("bigint"))
    return F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(a.alias("i"), b.alias("j")))))


def pin_exact(pins: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Requested items; a missing pin is a status row, or an error when strict."""
    found = pins.join(items.select("item_id").distinct().withColumn("_hit", F.lit(True)), "item_id", "left")
    status = F.when(F.col("_hit"), "found")
    miss = F.raise_error(F.concat(F.lit("pinned item missing: "), F.col("item_id"))).cast("string")
    return found.withColumn("status", status.otherwise(miss if strict else F.lit("missing"))).drop("_hit")


def pin_or_first(results: DataFrame, pins: DataFrame) -> DataFrame:
    """The pinned item of each query if it was returned, else the first; fallback recorded.

    ``results``: ``query_id, item_id, position``; ``pins``: ``query_id, pin`` (may be NULL).
    """
    j = results.join(pins, "query_id")
    match = F.coalesce(F.col("item_id") == F.col("pin"), F.lit(False))
    best = latest_per_key(
        j.select("query_id", "item_id", "pin", match.alias("matched"), "position"), ["query_id"],
        F.struct((~F.col("matched")).alias("m"), "position"), first=True,
    )
    return best.select("query_id", "item_id", (F.col("pin").isNotNull() & ~F.col("matched")).alias("fell_back"))


def filter_items(items: DataFrame, collection: str, box, d0: str, d1: str, platforms: list[str]) -> DataFrame:
    """Items of a collection meeting a box and date range, from the given platforms."""
    return items.where(
        (F.col("collection") == collection)
        & (F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1])
        & F.col("day").between(F.lit(d0).cast("date"), F.lit(d1).cast("date")) & F.col("platform").isin(*platforms)
    )


def stable_item(item: Column) -> Column:
    """Item id without its production stamp."""
    return F.array_join(F.slice(F.split(item, r"\."), 1, 4), ".")


def dedupe_latest(items: DataFrame) -> DataFrame:
    """Per (product, day, tile, collection) the item with the greatest production stamp."""
    stamp = F.split_part("item_id", F.lit("."), F.lit(5))
    return latest_per_key(items.withColumn("item_key", stable_item(F.col("item_id"))), ["item_key"], stamp)


def collect_assets(files: DataFrame, product_prefix: str, assets: list[str]) -> DataFrame:
    """One row per item with a map of asset to path, for one product family.

    ``files.path`` ends in ``<item>_<asset>.<ext>``.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    asset = F.regexp_extract(stem, "_(" + "|".join(assets) + ")$", 1)
    f = files.select("path", stem.alias("_s"), asset.alias("asset")).where(
        (F.col("asset") != "") & F.startswith("_s", F.lit(product_prefix))
    )
    item = F.expr("substring(_s, 1, length(_s) - length(asset) - 1)")
    return f.select(item.alias("item_id"), "asset", "path").groupBy("item_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("asset", "path")))).alias("assets")
    )


def asset_role(name: Column) -> Column:
    """Role of a product file from its name; unknown files have none."""
    has = lambda s: F.contains(name, F.lit(s))
    return (
        F.when(has("CH4ENH") & ~has("UNCERT"), "ch4_enhancement")
        .when(has("CH4UNCERT"), "ch4_uncertainty")
        .when(has("CH4SENS"), "ch4_sensitivity")
    )


def missing_assets(requested: DataFrame, available: DataFrame, assets: list[str]) -> DataFrame:
    """Requested (item, asset) pairs that are not available."""
    want = requested.select("item_id", F.explode(F.array(*[F.lit(a) for a in assets])).alias("asset"))
    return want.join(available.select("item_id", "asset"), ["item_id", "asset"], "left_anti")


def coverage_profile(store: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """First and last time, steps, grid size and absent variables of a long gridded store."""
    return store.groupBy(*keys).agg(
        F.min("ts").alias("t_first"), F.max("ts").alias("t_last"), F.countDistinct("ts").alias("n_steps"),
        F.countDistinct("lat").alias("n_lat"), F.countDistinct("lon").alias("n_lon"),
        F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.collect_set("variable"))).alias("missing"),
    )
