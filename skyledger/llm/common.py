"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import apply_runtime_conf, materialise

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bounds of a labelled sample: documents, bytes of their texts, and bytes of a single text (longer ones are passed over).
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LONGEST = 6_000, 24_000_000, 240_000


def prepared(spark: SparkSession) -> SparkSession:
    """Session options of the text operators: small Arrow batches, because one text can be very long."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def per_text(
    docs: DataFrame, schema: str, names: list[str], fn: Callable[[str], tuple], keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keys`` of every row with the values of ``fn(text)``; a NULL text counts as empty.

    Only ``keys`` and ``text`` are read, so other columns of ``docs`` may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t or "") for t in batch.column("text").to_pylist()]
            if rows:
                cols = [pa.array(c) if types[i] is None else pa.array(c, types[i]) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + cols, names=[*keys, *names])

    kept = docs.select(*keys, "text")
    head = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    types = [arrow.get(part.split()[-1]) for part in schema.split(", ")]
    return kept.mapInArrow(run, f"{head}, {schema}")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, n: int, held_out: int, rows: int, size: int) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``rows`` labelled documents and ``size`` bytes, in the order of a hash of the id.

    Rows whose id has the remainder ``held_out`` by ``n`` are left out, as are rows without
    an id or a label, and texts of more than ``SAMPLE_LONGEST`` bytes. The bytes are added
    up over ids and lengths alone; only chosen texts are read. Of several texts of one id
    the first in their order counts.
    """
    marked = labels.where(id_remainder(F.col("doc_id"), n) != held_out).where(F.col(target).isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(target).alias("label")).withColumn("order", F.xxhash64("doc_id"))
    marked = marked.orderBy("order", "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(F.broadcast(marked), "doc_id")
    lengths = lengths.groupBy("doc_id", "order", "label").agg(F.max("bytes").alias("bytes"))
    lengths = lengths.where(F.col("bytes") <= min(SAMPLE_LONGEST, size))
    chosen = lengths.withColumn("sum", F.sum("bytes").over(Window.orderBy("order", "doc_id"))).where(F.col("sum") <= size)
    chosen = materialise(chosen.select("doc_id", "order", "label"), "labelled_ids")
    kept = texts.join(F.broadcast(chosen), "doc_id").groupBy("order", "doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], int(r["label"])) for r in sorted(kept.toLocalIterator(), key=lambda r: (r["order"], r["doc_id"]))]


def tree_nodes(tree):
    """A fitted tree as nested tuples ``(feature, threshold, left, right)`` with values at the leaves."""

    def walk(node):
        if node.numDescendants() == 0:
            return node.prediction()
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))
