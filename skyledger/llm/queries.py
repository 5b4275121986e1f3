"""The text operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, compression, licenses, mixing, packing, pii, rules, simhash, token_counts, toxicity, variants, winnow
from .common import documents, labels

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_simhash": _over_documents(simhash.op1),
    "op2_quality": lambda spark, sf_dir: compression.op2(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op3_licenses": _over_documents(licenses.op3),
    "op4_quality_rules": _over_documents(rules.op4),
    "op5_toxicity": lambda spark, sf_dir: toxicity.op5(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op6_token_counts": _over_documents(token_counts.op6),
    "op7_mix": _over_documents(mixing.op7),
    "op8_pii": _over_documents(pii.op8),
    "op9_packing": _over_documents(packing.op9),
    "op10_winnowing": _over_documents(winnow.op10),
    "op11_collocations": _over_documents(collocations.op11),
    "op12_bpe": _over_documents(bpe.op12),
    "op13_spelling": _over_documents(variants.op13),
}
TWINS: dict[str, str] = {"op3_licenses": licenses.OP3_SQL, "op7_mix": mixing.OP7_SQL, "op11_collocations": collocations.OP11_SQL}
