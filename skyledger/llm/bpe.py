"""Byte-level BPE: texts to token ids by a segment tree over pair ranks, and ids back to bytes."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of each of a worker's two tables of encoded pre-tokens (keys and ids, with what Python adds), and characters of the longest one kept there.
TABLE_BYTES, KEPT = 64 << 20, 64
#: Characters of a text that are split into pre-tokens at once.
SLICE = 1 << 18
_NONE = 1 << 62


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one pre-token: as long as neighbouring tokens form a token, the pair of lowest rank, the leftmost of equals, is merged.

    A segment tree over byte positions has at each leaf the rank of the pair whose first
    token begins there (with the position, so that a minimum is the leftmost of equals), and at
    its root the next pair to merge. A merge takes the second token's leaf out and renews the
    leaves of the new token and of the one before it; the three climb to the root together, as
    tokens are short and their paths soon meet. A pre-token of n bytes takes O(n log n).
    """
    known = ranks.get(piece)
    if known is not None:
        return (known,)
    get, n = ranks.get, len(piece)
    shift = n.bit_length()
    place = (1 << shift) - 1
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # Long pre-tokens: 8 bytes a node instead of an object.
    tree = [_NONE] * (2 * n) if n < 1 << 16 else array("q", [_NONE]) * (2 * n)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[n + i] = rank << shift | i
    for i in range(n - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while tree[1] < _NONE:
        i = tree[1] & place
        j = ends[i]
        end = ends[i] = ends[j]
        low, high = n + i, n + j
        tree[high] = tree[low] = _NONE
        if end < n:
            before[end] = i
            rank = get(piece[i : ends[end]])
            if rank is not None:
                tree[low] = rank << shift | i
        if i:
            h = before[i]
            low = n + h
            rank = get(piece[h:end])
            tree[low] = _NONE if rank is None else rank << shift | h
        while high > 1:
            low >>= 1
            high >>= 1
            k = low or 1
            while k <= high:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k += 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tuple(out)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of at least ``size`` characters, cut only before white space that follows something else.

    No pre-token goes past such a place: white space begins one or stands alone.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


_CUT = regex.compile(r"(?<=\S)\s")


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dictionary, the ids of the pre-tokens met lately.

    A full table becomes the older one: what is met again moves back, the rest goes when the
    table is full once more. So common pre-tokens stay, and both hold bounded bytes.
    """

    def __init__(self, ranks: str, split: str):
        super().__init__()
        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(split)
        self.held = 0
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = merged(piece.encode(), self.ranks)
        if len(piece) <= KEPT:
            if self.held > TABLE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self.held += 200 + len(piece) + 16 * len(ids)
            self[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        ids = array("i")
        for part in slices(text):
            ids.extend(chain.from_iterable(map(self.__getitem__, self.split.findall(part))))
        return ids

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of the tokens; None if one is not in the vocabulary."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            return None


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: str, split: str) -> Codec:
    """The worker's codec; its table serves later tasks too."""
    if (ranks, split) not in _CODECS:
        _CODECS.clear()
        _CODECS[ranks, split] = Codec(ranks, split)
    return _CODECS[ranks, split]


def _lists(rows: list[array]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate([np.frombuffer(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _mapped(df: DataFrame, source: str, keep: tuple[str, ...], ranks: str | None, split: str | None, outputs: str, work) -> DataFrame:
    ranks, split = ranks or ranks_path(), split or pattern()
    names = [*keep, *(o.split()[0] for o in outputs.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, split)
        for batch in batches:
            made = work(own, batch.column(source))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, names=names)

    kept = df.select(*keep, source)
    head = "".join(f"`{k}` {kept.schema[k].dataType.simpleString()}, " for k in keep)
    return kept.mapInArrow(run, head + outputs)


def _encoded(own: Codec, texts: pa.Array) -> list[pa.Array]:
    return [_lists([own.encode(t or "") for t in texts.to_pylist()])]


def _decoded(own: Codec, ids: pa.Array) -> list[pa.Array]:
    return [pa.array([own.decode(row or []) for row in ids.to_pylist()], pa.binary())]


def _both(own: Codec, texts: pa.Array) -> list[pa.Array]:
    rows = [own.encode(t or "") for t in texts.to_pylist()]
    return [_lists(rows), pa.array([own.decode(r) for r in rows], pa.binary())]


def encode(docs: DataFrame, ranks: str | None = None, split: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row's whole text.

    ``ranks`` names a vocabulary of merge ranks, ``split`` the pattern of pre-tokens. Strings
    of special tokens are ordinary text. NULL and empty texts have no ids; repeated rows each
    have their own; other columns than ``keep`` and ``text`` are not read; an empty table
    gives no rows. A pre-token of any length is encoded whole.
    """
    return _mapped(docs, "text", keep, ranks, split, "ids array<int>", _encoded)


def decode(tokens: DataFrame, ranks: str | None = None, split: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded`` (bytes) of every row's ``ids``; empty for NULL or no ids, NULL where an id is unknown."""
    return _mapped(tokens, "ids", keep, ranks, split, "decoded binary", _decoded)


def round_trip(docs: DataFrame, ranks: str | None = None, split: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: :func:`encode` and :func:`decode` in one pass, so ids travel once."""
    return _mapped(docs, "text", keep, ranks, split, "ids array<int>, decoded binary", _both)


def op12(docs: DataFrame) -> DataFrame:
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return round_trip(docs).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
