"""Document fingerprints by winnowing, with built-in column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Units of a k-gram and k-grams of a window; both are powers of two, so both fold by doubling.
GRAM, WINDOW = 4, 8
#: A unit: one ideograph or kana sign, or up to 16 other characters without white space.
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,16}"
_LOW = (1 << 31) - 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _doubled(values: Column, size: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of every run of ``size`` neighbours, by doubling; a shorter array folds to what it has."""

    def fold(step: int) -> Callable[[Column], Column]:
        def use(v: Column) -> Column:
            reach = F.size(v) - step
            both = F.zip_with(F.slice(v, F.lit(1), reach), F.slice(v, F.lit(step + 1), reach), join)
            return F.when(reach > 0, both).otherwise(v)

        return use

    step = 1
    while step < size:
        values = bound(values, fold(step))
        step *= 2
    return values


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """31-bit hashes of all k-grams of a text's units, in order.

    Hashes roll by doubling: the hash of 2k units is made of the hashes of its halves.
    A text of fewer units than a k-gram has fewer, shorter grams; one without units has none.
    """
    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    grams = _doubled(units, gram, lambda a, b: F.xxhash64(a, b))
    return F.transform(grams, lambda h: F.shiftrightunsigned(h, 33))


def selected(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The winnowed k-grams in order: array of ``hash << 31 | (2^31 - 1 - position)``.

    Every window of ``window`` neighbouring k-grams keeps its smallest hash, the rightmost
    on ties: the position counts down in the low bits, so a plain minimum decides both.
    Two texts that share ``gram + window - 1`` units share a kept k-gram.
    """
    placed = F.transform(
        gram_hashes(text, gram),
        lambda h, i: F.shiftleft(h, 31).bitwiseOR(F.lit(_LOW) - i.cast("bigint")),
    )
    return F.array_distinct(_doubled(placed, window, lambda a, b: F.least(a, b)))


def hashes(kept: Column) -> Column:
    """The distinct hashes of :func:`selected`."""
    return F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, 31).cast("int")))


def positions(kept: Column) -> Column:
    """Position and hash of every kept k-gram, in order."""
    return F.transform(
        kept,
        lambda v: F.struct(
            (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("int").alias("position"),
            F.shiftrightunsigned(v, 31).cast("int").alias("hash"),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes; 1 for two empty fingerprints."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def digest(kept: Column) -> Column:
    """A text form of the fingerprint: SHA-256 of its hashes and their positions."""
    return F.sha2(kept.cast("string"), 256)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, kept`` (position and hash) of every row; a NULL or blank text keeps none."""
    kept = selected(F.coalesce("text", F.lit("")), gram, window)
    return docs.select("doc_id", positions(kept).alias("kept"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, id_key, text_key``: equal rows have equal keys, and no key is NULL."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("="), F.col("doc_id").cast("string"))
    return own.select("*", F.coalesce(name, F.lit("")).alias("id_key"), F.xxhash64("text").alias("text_key"))


def _ordered(own: DataFrame) -> DataFrame:
    """``n`` (rank by doc_id, NULL last, then by a hash of the text, from 1) of every distinct row, as a table.

    With ``id_key, text_key, n_chars`` and ``times``, the number of equal rows. Keys alone are
    range-partitioned; a rank is the place in its partition plus the counts before.
    """
    lengths = own.groupBy("id_key", "text_key").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n_chars"), F.count("*").alias("times")
    )
    by = F.col("doc_id").asc_nulls_last(), F.col("text_key")
    placed = lengths.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "winnow_order")
    part = F.shiftright("place", 33)
    runs = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"), F.min("place").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    runs = materialise(runs, "winnow_runs")
    rank = F.col("place") - F.col("first") + F.col("before") + 1
    return placed.join(runs, part == F.col("part")).select(rank.alias("n"), "id_key", "text_key", "n_chars", "times")


def edited_neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every row with its fingerprint, its edited text and their likeness.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.
    The edited text ends with the first ``floor(n_chars / 4)`` characters (or all) of the
    next row in place of as many of its own; after the last comes the first. Rows are
    ordered by doc_id, NULL last, those of one doc_id by a hash of the text; equal rows
    follow each other, and all but their last have themselves as the next. A row is told
    who stands before it and how much of its beginning that one takes, and sends this and
    its hashes there: texts are dealt once by key, beginnings once more. NULL texts are
    empty, a row alone is its own next, an empty table gives no rows.
    """
    own = _keyed(docs)
    order = materialise(_ordered(own), "winnow_ranks")
    total = order.agg(F.max("n")).first()[0] or 1
    before = order.select(
        (F.col("n") % total + 1).alias("m"), F.col("id_key").alias("before_id"), F.col("text_key").alias("before_text"),
        F.col("n_chars").alias("before_chars"),
    )
    told = order.join(before, F.col("n") == F.col("m")).select(
        "id_key", "text_key", "n_chars", "times", "before_id", "before_text", "before_chars"
    )

    kept = own.select("*", selected(F.col("text"), gram, window).alias("kept"))
    kept = kept.select("id_key", "text_key", "text", digest(F.col("kept")).alias("fingerprint"), hashes(F.col("kept")).alias("hashes"))
    # Both uses of this read the same columns, so texts are exchanged once; the id is taken from its key at the end.
    base = kept.dropDuplicates(["id_key", "text_key"])

    def taker(id_key: str, text_key: str, chars: str, rows: Column) -> Column:
        cols = F.col(id_key).alias("id"), F.col(text_key).alias("t"), F.col(chars).alias("chars"), rows.alias("rows")
        return F.struct(*cols)

    takers = F.array(
        taker("before_id", "before_text", "before_chars", F.lit(1).cast("bigint")),
        taker("id_key", "text_key", "n_chars", F.col("times") - 1),
    )
    sent = base.join(told, ["id_key", "text_key"]).select("*", F.explode(F.filter(takers, lambda x: x["rows"] > 0)).alias("to"))
    sent = sent.select(
        F.col("to.id").alias("to_id"),
        F.col("to.t").alias("to_text"),
        F.col("to.rows").alias("rows"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("to.chars") / 4).cast("int")).alias("head"),
        F.col("fingerprint").alias("next_fingerprint"),
        F.col("hashes").alias("next_hashes"),
    )
    id_of = F.when(F.col("id_key") != "", F.substring("id_key", 2, 2**31 - 1)).cast(docs.schema["doc_id"].dataType)
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), "head")
    met = base.join(sent, (F.col("id_key") == F.col("to_id")) & (F.col("text_key") == F.col("to_text"))).select(
        id_of.alias("doc_id"), n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "hashes", "next_fingerprint", "next_hashes", "rows"
    )
    met = met.select("*", selected(F.col("edited"), gram, window).alias("edited_kept"))
    out = met.select(
        "rows", "doc_id", "n_chars", "edited", "fingerprint", digest(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edited_kept"))).alias("near_edited"),
        F.when(F.col("fingerprint") == F.col("next_fingerprint"), F.lit(1.0))
        .otherwise(likeness(F.col("hashes"), F.col("next_hashes"))).alias("near_next"),
    )
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).drop("rows", "col")


def op10(docs: DataFrame) -> DataFrame:
    out = edited_neighbours(docs)
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )
