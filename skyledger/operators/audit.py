"""Inventories, structural differences, citations and claims."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that claim proximity, and phrases that may not appear.
PROXIMITY = r"(?i)\b(nearest|closest|closer|farther|farthest)\b"
BANNED = ("closer in both", "both distance and angle")


def audit_files(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between a manifest and the files found: missing, unexpected, hash mismatch."""
    j = manifest.select("path", F.col("sha256").alias("want")).join(
        actual.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(
        F.col("want") != F.col("got"), "hash mismatch")
    return j.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


def verdict(n_failures: Column, is_head: Column) -> Column:
    return F.when(n_failures > 0, "RED").when(~is_head, "WARNING").otherwise("GREEN")


#: Rows of both sides that one task of :func:`missing_both_ways` compares, about.
TASK_ROWS = 500_000


def missing_both_ways(a: DataFrame, b: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """Keys of either side without a partner, tagged by side; a key with a NULL has none.

    Both sides are exchanged once by their keys, to a task for about every ``rows`` rows, and meet
    in one aggregate, so that a task's memory does not grow with the inventories.
    """
    sides = a.select(*keys, F.lit(True).alias("_left")).unionByName(b.select(*keys, F.lit(False).alias("_left")))
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sides.count() // rows))
    met = sides.repartition(tasks, *keys).groupBy(*keys).agg(F.bool_or("_left").alias("_l"), F.bool_or(~F.col("_left")).alias("_r"))
    alone = reduce(Column.__or__, [F.col(k).isNull() for k in keys], F.col("_l") != F.col("_r"))
    side = F.explode(F.array_compact(F.array(F.when(F.col("_l"), F.lit("left only")), F.when(F.col("_r"), F.lit("right only")))))
    return met.where(alone).select(*keys, side.alias("side"))


def unsupported(citations: DataFrame, features: DataFrame) -> DataFrame:
    """Cited (layer, feature) pairs that do not exist."""
    return citations.join(features.select("layer", "feature_id").distinct(), ["layer", "feature_id"], "left_anti")


def _refuse(word: str):
    raise ValueError(word)


def _parsed(doc: str | None) -> tuple[bool, object]:
    """Whether a text is JSON, and its value. NaN and infinities are not, nor is what nests deeper than Python's parser goes."""
    try:
        return doc is not None, json.loads(doc, parse_constant=_refuse) if doc is not None else None
    except (ValueError, RecursionError):
        return False, None


def _divergences(want: object, got: object) -> Iterator[tuple[tuple[str, ...], str]]:
    """Steps to every place where two JSON values part, and how; nothing below such a place is compared."""
    todo: list[tuple[tuple[str, ...], object, object]] = [((), want, got)]
    while todo:
        steps, a, b = todo.pop()
        if type(a) is not type(b):
            yield steps, "type"
        elif isinstance(a, dict):
            for name in a.keys() ^ b.keys():
                yield (*steps, f".{name}"), "missing in got" if name in a else "missing in expected"
            todo += [((*steps, f".{name}"), a[name], b[name]) for name in a.keys() & b.keys()]
        elif isinstance(a, list) and len(a) == len(b):
            todo += [((*steps, f"[{i}]"), x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        elif a != b:
            yield steps, "length" if isinstance(a, list) else "value"


def _compare_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, counts, paths, kinds = [], [], [], []
        for i, (a, b, in_a, in_b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "in_a", "in_b")), strict=True)):
            if in_a and in_b:
                (good_a, want), (good_b, got) = _parsed(a), _parsed(b)
                found = list(_divergences(want, got)) if good_a and good_b else [((), "type")] if good_a or good_b else []
            else:
                found = [((), "missing in got" if in_a else "missing in expected")]
            if found:
                path, kind = min(("$" + "".join(steps), kind) for steps, kind in found)
                place.append(i)
                counts.append(len(found))
                paths.append(path)
                kinds.append(kind)
        key = batch.column(0).take(pa.array(place, pa.int64()))
        yield pa.RecordBatch.from_arrays([key, pa.array(counts, pa.int64()), pa.array(paths, pa.string()), pa.array(kinds, pa.string())],
                                         names=[batch.schema.names[0], "n_diff", "path", "kind"])


def first_difference(expected: DataFrame, got: DataFrame, key: str, doc: str) -> DataFrame:
    """First diverging path per document and the number of divergences, at any depth.

    A member that one side lacks, another type, another list length or another value is a
    divergence, and nothing below it is compared. A document of one side only, or one
    that is not JSON, diverges at ``$``; two that are not JSON agree. Whole numbers are compared
    exactly and differ in type from floats, as lists from objects and booleans from numbers; the
    order of members does not matter. Members meet by their steps, so names may hold points.
    Equal texts are settled by the join; only the others are opened, batch by batch.
    """
    a = expected.select(key, F.col(doc).alias("a"), F.lit(True).alias("in_a"))
    b = got.select(key, F.col(doc).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer").select(key, "a", "b", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_a", "in_b")])
    differ = both.where(~(F.col("in_a") & F.col("in_b") & F.col("a").eqNullSafe(F.col("b"))))
    kind = both.schema[key].dataType.simpleString()
    return differ.mapInArrow(_compare_documents, f"`{key}` {kind}, n_diff bigint, path string, kind string")


def dedupe_citations(refs: DataFrame) -> DataFrame:
    """First reference per identifier (doi, else url, else text), white space collapsed."""
    ident = F.trim(F.coalesce("doi", "url", "cite"))
    return refs.withColumn("ident", ident).groupBy("ident").agg(
        F.min_by(F.struct("ord", F.trim(F.regexp_replace("cite", r"\s+", " ")).alias("cite"), "source"), F.col("ord")).alias("r")
    ).select("ident", "r.*")


def claim_checks(claims: DataFrame, table: DataFrame, id_label: str = "OGIM_ID") -> DataFrame:
    """Proximity wording against the computed candidate table.

    ``claims``: ``event_id, claim_id, text``; ``table``: ``event_id, top_id,
    near_id``. A proximity claim must name, after ``id_label``, a feature that is one of the two.
    """
    t = F.col("text")
    named = F.regexp_extract(t, rf"{id_label} (\d+)", 1)
    j = claims.join(table, "event_id", "left")
    claim = t.rlike(PROXIMITY)
    banned = reduce(lambda x, y: x | y, [F.contains(F.lower(t), F.lit(b)) for b in BANNED])
    fid = F.when(named != "", named).try_cast("bigint")
    status = (
        F.when(banned, "banned phrase").when(~claim, "no claim").when(F.col("top_id").isNull(), "no candidate table")
        .when(fid.isNull(), "no identifiable candidate")
        .when((fid == F.col("top_id")) | (fid == F.col("near_id")), "supported").otherwise("contradicted")
    )
    return j.select("event_id", "claim_id", status.alias("status"))
