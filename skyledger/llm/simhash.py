"""Near-duplicate documents by SimHash, linked through deletion variants of fingerprint segments."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import per_text
from .graph import components
from .minhash import without_near_duplicates  # noqa: F401

BITS = 64
#: Words of a shingle and seed of its hash.
SHINGLE, SEED = 4, 42
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 4
#: So many segments that DISTANCE differing bits leave one of them with one at most.
SEGMENTS = 3

_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 without words.

    A-Z are lower-cased and words are runs without ASCII white space. Every shingle of
    ``width`` words, repeats included, is hashed (fewer words: all of them once); a bit
    is 1 if it is set in over half the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist())], ">u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every row."""
    return per_text(docs, "fp bigint", ["fp"], lambda text: (fingerprint(text, width, seed),))


def _segments(count: int) -> list[tuple[int, int]]:
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def _signed(mask: int) -> int:
    return mask - 2**BITS if mask >= 2 ** (BITS - 1) else mask


def variants(fp: Column, count: int = SEGMENTS) -> Column:
    """The keys of a fingerprint: array of ``(slot, key, side)``.

    Each segment as it is (side 2), and each with one bit deleted, whose value is the
    side. Two segments that are equal share the first kind of key; two that differ in
    one bit share, on opposite sides, the one key that deletes it. So candidates meet
    exactly once per segment.
    """
    out = []
    for low, high in _segments(count):
        mask = (1 << high) - (1 << low)
        out.append(F.struct(F.lit(BITS + low).alias("slot"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key"), F.lit(2).alias("side")))
        for bit in range(low, high):
            rest = F.lit(_signed(mask & ~(1 << bit)))
            side = F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1)).cast("int")
            out.append(F.struct(F.lit(bit).alias("slot"), fp.bitwiseAND(rest).alias("key"), side.alias("side")))
    return F.array(*out)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints in ``fps`` (``fp``, distinct) within ``distance`` bits.

    ``SEGMENTS`` segments are right for ``distance`` up to 2 * SEGMENTS - 1. A join on
    equal keys finds the candidates and checks each on the spot, so only links leave it;
    a key that many fingerprints share is split by the adaptive skew join. The optimizer
    counts a fingerprint's 67 keys as one row, so the join is told not to broadcast them.
    """
    count = distance // 2 + 1
    keys = fps.select("fp", F.explode(variants(F.col("fp"), count)).alias("v")).select("fp", "v.slot", "v.key", "v.side")
    left = keys.where("side <> 1").select(F.col("fp").alias("a"), "slot", "key")
    right = keys.where("side <> 0").select(F.col("fp").alias("b"), F.col("slot").alias("s"), F.col("key").alias("k"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = (F.col("slot") < BITS) | (F.col("a") < F.col("b"))
    found = left.hint("merge").join(right.hint("merge"), (F.col("slot") == F.col("s")) & (F.col("key") == F.col("k")) & once & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the smallest doc_id reachable by links.

    Equal fingerprints (so exact copies and all texts without words) become one node
    before any join. NULL texts have no words. Rows without an id belong to their
    component but cannot name it; a component of such rows alone has a NULL id. Repeated
    rows each get a row; an empty table gives none.
    """
    rows = materialise(fingerprints(docs), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash_nodes")
    linked = components(links(nodes.select("fp"), distance))
    linked = materialise(linked, "simhash_components")
    named = linked.join(nodes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = linked.join(named, "component").select(F.col("node").alias("__node"), F.col("component_id").alias("__linked"))
    alone = nodes.select(F.col("fp").alias("__fp"), "low")
    every = alone.join(of_node, F.col("__fp") == F.col("__node"), "left").select(
        "__fp", F.when(F.col("__node").isNotNull(), F.col("__linked")).otherwise(F.col("low")).alias("component_id")
    )
    every = materialise(every, "simhash_classes")
    return rows.join(every, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def op1(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
