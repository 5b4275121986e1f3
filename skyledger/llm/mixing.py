"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD

#: The random offsets of all sources follow from this.
SEED = 7
#: A document that holds more than this part of its source has its expected copies stated one by one: fewer than this many a source.
LARGE = 1000


def n_words(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, NULL last,
    take ``weights`` in turn and share ``share`` (a fraction) of all sizes; no target
    exceeds ``cap`` times its source, and the excess is shared again by weight. With
    sources ordered by cap over weight the capped ones are a prefix, so the common
    level is the largest of the levels that each prefix would leave.
    """
    num, den = share
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("bigint"))
    room = F.lit(cap) * F.col("source_size")
    by_room = Window.orderBy(room.cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    per = per.select(
        "*",
        F.coalesce(F.sum(room).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(everything).alias("total"),
    )
    level = (F.lit(num) * F.col("total") - F.lit(den) * F.col("capped")).cast("double") / (F.lit(den) * F.col("rest"))
    per = per.withColumn("level", F.max(level).over(everything))
    target = F.least(room.cast("double"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """The random offset of a source, in [0, 1): from the seed and the source's name, so reruns agree."""
    name = F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("bigint") / F.lit(16777216.0)


def expected(left: Column, rest: Column, cap: int) -> Column:
    """Copies expected of the next document: words still wanted over words still to come, 0 to ``cap``."""
    return F.when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), left / rest.cast("double")))).otherwise(F.lit(0.0))


def crossed(before: Column, after: Column, cap: int) -> Column:
    """Integer boundaries between two prefix sums."""
    return F.least(F.floor(after) - F.floor(before), F.lit(cap)).cast("bigint")


def _large(sizes: Column, target: Column, words: Column, start: Column, cap: int) -> Column:
    """The prefix sum over a source's large documents: ``left, rest, reached, copies``, the last an array in their order."""
    state = F.struct(
        target.alias("left"), words.alias("rest"), start.alias("reached"), F.array().cast("array<bigint>").alias("copies")
    )

    def step(acc: Column, size: Column) -> Column:
        reached = acc["reached"] + expected(acc["left"], acc["rest"], cap)
        n = crossed(acc["reached"], reached, cap)
        return F.struct(
            (acc["left"] - (n * size).cast("double")).alias("left"), (acc["rest"] - size).alias("rest"),
            reached.alias("reached"), F.concat(acc["copies"], F.array(n)).alias("copies"),
        )

    return F.aggregate(sizes, state, step)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = SEED
) -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    ``docs`` has ``doc_id, source, size`` and any other columns, which are kept.
    Added: ``source_size``, ``target`` and ``copies`` (0 to ``cap``).

    Within a source, documents stand in the order of (size falling, doc_id). The prefix
    sum of their expected copies starts at the source's one random offset, and a document
    gets a copy for each integer its own part crosses. Expected are the words still wanted
    over the words still to come: on average the source's target over its size for every
    document, but what a large document takes too much or too little, smaller ones make
    up. For the fewer than ``LARGE`` documents of a source that hold more than that part of
    it this is stated one by one; after them the expectation no longer moves, so all others
    share one value and their prefix sum is a product.

    The order is global: rows are range-partitioned by (source, size, doc_id), a source of
    any size spreads over many partitions, and a document's rank is its place in its
    partition plus the counts of those before. Rows without a source are a source of
    their own, the last. Equal rows are separate documents. Empty texts have size 0 and
    may be taken. An empty table gives no rows.
    """
    order = ("source", F.desc("size"), "doc_id")
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialise(ranged, "mix")
    part = F.shiftright("__place", 33)
    runs = placed.groupBy("source", part.alias("__part")).agg(
        F.count("*").alias("n"), F.min("__place").alias("first"), F.sum("size").alias("size")
    )
    runs = materialise(runs, "mix_runs")
    targets = source_targets(runs.select("source", "size"), weights, share, cap)
    targets = targets.select(
        F.col("source").alias("__source"), F.col("source_size").alias("__words"), F.col("target").alias("__target")
    )
    targets = materialise(targets, "mix_targets")
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        F.col("source").alias("__name"), F.col("__part").alias("__run"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("__shift"),
    )
    of_source = F.col("source").eqNullSafe(F.col("__source"))
    large = placed.select("source", "size", "__place").join(targets, of_source).where(F.col("size") * LARGE > F.col("__words"))
    large = large.groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("__place", "size"))).alias("l"))
    large = large.select(F.col("__source").alias("__of"), F.col("l.size").alias("__sizes"))
    state = targets.join(large, F.col("__source").eqNullSafe(F.col("__of")), "left")
    sizes = F.coalesce("__sizes", F.array().cast("array<bigint>"))
    state = state.withColumn("s", _large(sizes, F.col("__target"), F.col("__words"), offset(F.col("__source"), seed), cap))
    plan = state.select(
        "__source", "__words", "__target", F.col("s.copies").alias("__stated"), F.col("s.reached").alias("__reached"),
        expected(F.col("s.left"), F.col("s.rest"), cap).alias("__rate"),
    )
    plan = materialise(plan, "mix_plan")
    full = placed.drop(*[c for c in ("source_size", "target", "copies") if c in placed.columns])
    full = full.join(shifts, F.col("source").eqNullSafe(F.col("__name")) & (part == F.col("__run"))).join(plan, of_source)
    rank = F.col("__place") + F.col("__shift")
    later = rank - F.size("__stated")
    product = crossed(F.col("__reached") + (later - 1) * F.col("__rate"), F.col("__reached") + later * F.col("__rate"), cap)
    n = F.when(later <= 0, F.get("__stated", (rank - 1).cast("int"))).otherwise(product)
    names = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    return full.select(
        *names, F.col("__words").alias("source_size"), F.col("__target").alias("target"), n.alias("copies")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    named = docs.columns
    inner = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mix(inner).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("row").getField(c).alias(c) for c in named]
    )


def op7(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s
), l AS (
  SELECT *,
    (3 * (sum(source_size) OVER ())::BIGINT
       - 2 * coalesce((sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
      / (2 * (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT)::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, source IS NULL, source)
), t AS (
  SELECT coalesce('s' || source, 'n') AS name, source_size, least((2 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target,
    ('0x' || substr(md5('{SEED}' || coalesce('s' || source, 'n')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS start
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY name ORDER BY size DESC, doc_id) AS k
  FROM d JOIN t ON t.name = coalesce('s' || d.source, 'n')
), f AS (
  SELECT name, 0::BIGINT AS k, target AS wanted, source_size AS rest, start AS reached, 0::BIGINT AS copies FROM t
  UNION ALL
  SELECT name, k, wanted - (copies * size)::DOUBLE, rest - size, reached, copies
  FROM (
    SELECT name, k, size, wanted, rest, reached + rate AS reached, least(floor(reached + rate) - floor(reached), 2)::BIGINT AS copies
    FROM (
      SELECT r.name, r.k, r.size, wanted, rest, reached,
        CASE WHEN rest > 0 THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, wanted / rest::DOUBLE)) ELSE 0.0::DOUBLE END AS rate
      FROM f JOIN r ON r.name = f.name AND r.k = f.k + 1 WHERE r.size * {LARGE} > r.source_size
    )
  )
), e AS (
  SELECT name, k AS n, reached, CASE WHEN rest > 0 THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, wanted / rest::DOUBLE)) ELSE 0.0::DOUBLE END AS rate
  FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1
), c AS (
  SELECT r.*, coalesce(f.copies, least(floor(e.reached + (r.k - n) * e.rate) - floor(e.reached + (r.k - n - 1) * e.rate), 2)::BIGINT) AS copies
  FROM r JOIN e ON r.name = e.name LEFT JOIN f ON r.name = f.name AND r.k = f.k
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
