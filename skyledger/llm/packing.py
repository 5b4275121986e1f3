"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import base64
import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CAPACITY = 1024
END_ID = 2
#: Entries of a worker's table of encoded chunks; beyond it the table is started anew.
MEMO_ENTRIES = 200_000
#: Characters that form a pre-token of their own after a letter.
TRAILING = ".,!*#$%&|;:"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary as merge ranks, for the faster encoder of single chunks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Unsafe(Exception):
    """A chunk that touches another white-space character."""


class ChunkEncoder(dict):
    """Little-endian 32-bit ids of a text, through a table of encoded space-delimited chunks.

    The vocabulary's pre-tokens never span a single space between two characters that
    are not white space, except as the first character of the one after it; nor a single
    line feed between two such characters, nor the place between a letter and
    ``TRAILING``. So a text may be cut there and its chunks encoded one by one. Chunks of
    Latin characters missing from the table are encoded from the merge ranks of the same
    vocabulary, if given; all others, and texts with other white space, by the tokenizer.
    Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, ranks: str | None = None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bare: dict[str, bytes] = {}
        self.by_rank = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            ).encode_ordinary

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def single(self, chunk: str) -> bytes:
        if self.by_rank and max(chunk) < "\u0250":
            return array("I", self.by_rank(chunk)).tobytes()
        return self.whole(chunk)

    def without_space(self, chunk: str) -> bytes:
        ids = self.bare.get(chunk)
        if ids is None:
            ids = self.bare[chunk] = self.single(chunk)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        if "\n" in chunk:
            head, *lines = chunk.split("\n")
            if any(not x or x[0].isspace() or x[-1].isspace() for x in (head, *lines)):
                raise _Unsafe
            feed = self.without_space("\n")
            ids = self[head] + b"".join(feed + self.without_space(x) for x in lines)
        else:
            stem = chunk.rstrip(TRAILING)
            if stem and stem != chunk and stem[-1].isalpha():
                ids = self[stem] + self.without_space(chunk[len(stem) :])
            else:
                ids = self.single(" " + chunk)
        self[chunk] = ids
        return ids

    def count(self, piece: str) -> int:
        """Tokens of a piece of text that ends, and starts, where a text may be cut."""
        if not piece:
            return 0
        if len(self) > MEMO_ENTRIES:
            self.clear()
        first, *rest = piece.split(" ")
        try:
            # A piece that starts with a space has an empty first chunk and no lone space before the second.
            head = 0 if not first and rest else len(self.whole(first)) if not first[-1:].isspace() else None
            if head is None:
                raise _Unsafe
            return (head + sum(map(len, map(self.__getitem__, rest)))) // 4
        except _Unsafe:
            return len(self.whole(piece)) // 4

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Chunks are looked up once per group of texts and put together by array arithmetic."""
        for table in (self, self.bare):
            if len(table) > MEMO_ENTRIES:
                table.clear()
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        words, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
        # There are fewer chunks, and fewer ids, than bytes.
        index = np.int32 if texts.nbytes < 2**31 else np.int64
        coded = words.dictionary_encode()
        firsts = words.take(pa.array(bounds[:-1])).to_pylist()
        del split, words
        codes = coded.indices.to_numpy().astype(index)
        follow = np.ones(len(codes), bool)
        follow[bounds[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[follow]] = True
        parts, unsafe = [], np.zeros(len(used) + len(firsts), bool)
        for i, (chunk, wanted) in enumerate(zip(coded.dictionary.to_pylist(), used.tolist())):
            try:
                parts.append(self[chunk] if wanted else b"")
            except _Unsafe:
                parts.append(b"")
                unsafe[i] = True
        for i, chunk in enumerate(firsts, len(used)):
            unsafe[i] = not chunk or chunk[-1].isspace()
            parts.append(b"" if unsafe[i] else self.whole(chunk))
        codes[bounds[:-1]] = np.arange(len(firsts)) + len(used)
        del coded
        sizes = np.fromiter(map(len, parts), index, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        del parts
        begin = np.cumsum(sizes, dtype=index) - sizes
        each = sizes[codes]
        ends = np.cumsum(each, dtype=index)
        place = np.repeat(begin[codes] - (ends - each), each)
        place += np.arange(len(place), dtype=index)
        out = pool[place]
        del place
        cut = np.concatenate([[0], ends])[bounds]
        bad = np.logical_or.reduceat(unsafe[codes], bounds[:-1]) if len(firsts) else []
        return [
            self.whole(texts[i].as_py()) if bad[i] else out[cut[i] : cut[i + 1]].tobytes() for i in range(len(firsts))
        ]


_ENCODERS: dict[tuple[str, str | None], ChunkEncoder] = {}


def encoder(path: str, ranks: str | None) -> ChunkEncoder:
    """The worker's encoder; its table serves the worker's later tasks too."""
    key = (path, ranks)
    if key not in _ENCODERS:
        # The system's allocator gives the memory of a large group of texts back; so does what earlier stages of the worker used.
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
        _ENCODERS[key] = ChunkEncoder(path, ranks)
    return _ENCODERS[key]


def groups(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches put together until they hold about ``size`` bytes; a worker's memory grows with that."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids, part, place``.

    A document is its ids and then ``end_id``. One longer than ``capacity`` is cut into
    pieces of ``capacity``, the first of which may be shorter. ``ids`` are 32-bit
    little-endian. ``place`` counts a task's pieces of the same length and ``part`` names
    the task, so that places can be numbered later without another sort. NULL texts are
    empty: their one piece holds ``end_id`` alone.
    """
    path, ranks = (path, None) if path else (tokenizer_path(), ranks_path())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path, ranks).encode_many, TaskContext.get().partitionId(), [0] * (capacity + 1)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        for batch in groups(batches):
            cols: list[list] = [[] for _ in kinds]
            source: list[int] = []
            for row, ids in enumerate(encode(pc.fill_null(batch.column("text"), ""))):
                ids += end
                n = len(ids) // 4
                start, piece, step = 0, 0, n % capacity or capacity
                while start < n:
                    source.append(row)
                    for c, v in zip(cols, (piece, start, step, ids[4 * start : 4 * (start + step)], part, seen[step])):
                        c.append(v)
                    seen[step] += 1
                    start, piece, step = start + step, piece + 1, capacity
            keys = batch.column("doc_id").take(pa.array(source, pa.int64()))
            arrays = [keys] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids", "part", "place"])
            del batch, arrays, keys, cols
            pa.default_memory_pool().release_unused()

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, place bigint"
    )


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where items of each length go, and the number of bins.

    Rows ``(length, first, items, per_bin, bin, offset)``: the items of this length
    numbered ``first .. first + items - 1`` fill bins ``bin, bin + 1, ...`` with
    ``per_bin`` of them each, from ``offset`` on. Works on counts per length, so its
    cost depends on the capacity alone. Lengths above a third of the capacity are
    matched greedily, the longest with the longest that fits; shorter ones, in falling
    order, go where they leave the least room.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    done = dict.fromkeys(left, 0)
    rows: list[tuple[int, ...]] = []
    gaps: list[int] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def place(s: int, items: int, per_bin: int, first_bin: int, offset: int) -> None:
        rows.append((s, done[s], items, per_bin, first_bin, offset))
        done[s] += items
        left[s] -= items

    def offer(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if gap not in open_bins:
                open_bins[gap] = []
                insort(gaps, gap)
            open_bins[gap].append((first_bin, n))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= capacity - a and b <= a and left[b] >= (2 if a == b else 1)), None)
            if b is None:
                n = left[a]
                place(a, n, 1, bins, 0)
                offer(capacity - a, bins, n)
            elif a == b:
                n = left[a] // 2
                place(a, 2 * n, 2, bins, 0)
                offer(capacity - 2 * a, bins, n)
            else:
                n = min(left[a], left[b])
                place(a, n, 1, bins, 0)
                place(b, n, 1, bins, a)
                offer(capacity - a - b, bins, n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                offer(capacity, bins, n)
                bins += n
                continue
            gap = gaps[at]
            first_bin, n = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            fit = gap // s
            full = min(n, left[s] // fit)
            if full:
                place(s, full * fit, fit, first_bin, capacity - gap)
                offer(gap - fit * s, first_bin, full)
                offer(gap, first_bin + full, n - full)
            else:
                rest = left[s]
                place(s, rest, rest, first_bin, capacity - gap)
                offer(gap - rest * s, first_bin, 1)
                offer(gap, first_bin + 1, n - 1)
    return np.array(sorted(rows), np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``part`` and ``place``; other columns are kept.

    ``pieces`` must be a table, not a computation: it is read twice. Each piece gets a
    number among those of its length (the counts of the tasks before, plus its place), and
    the bounded plan of :func:`plan_bins` turns the number into a sequence. Neither text nor
    ids are sorted, and a length that most pieces have is spread over the tasks that made them.
    """
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    per_part = materialise(per_part, "pack_counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    numbered = pieces.join(bases, ["length", "part"]).withColumn("__rank", F.col("__base") + F.col("place"))
    names = [c for c in pieces.columns if c not in ("part", "place", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * 2**50 + plan[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = plan[np.searchsorted(keys, size * 2**50 + rank, side="right") - 1]
            inside = rank - row[:, 1]
            bins, offset = row[:, 4] + inside // row[:, 3], row[:, 5] + inside % row[:, 3] * size
            arrays = [batch.column(c) for c in names] + [pa.array(bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    kinds = [f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names]
    return numbered.select(*names, "__rank").mapInArrow(run, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack ``docs``: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    Repeated rows are separate documents; NULL ids stay NULL; an empty table gives no rows.
    """
    return pack(materialise(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order, ready to be written for training."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))


def op9(docs: DataFrame) -> DataFrame:
    pieces = materialise(token_pieces(docs), "pieces")
    digest = pieces.select("doc_id", "piece", "start", "length", "part", "place", F.crc32("ids").alias("ids_crc32"))
    return pack(digest)
