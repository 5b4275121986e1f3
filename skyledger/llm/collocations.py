"""Phrase collocations: n-gram counts through a prefix-free parse, scored by their weakest cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .packing import groups

#: Words of the longest phrase, least count of a phrase, phrases of a language in the report.
MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A word whose CRC-32 is divisible by this starts a chunk; a chunk also ends after so many words of its own.
TRIGGER, LONGEST = 16, 512
#: Ends a piece inside a chunk. No word can hold it, because it separates pieces.
END = "."
#: Characters and number of the chunks or n-grams a task adds up before it hands them on.
HELD_BYTES, HELD = 32 << 20, 400_000
#: Buckets for pairs of words, as a power of two, and the blocks in which their counters travel.
BUCKET_BITS, BLOCKS = 26, 64
#: Odd factors of a multiplicative hash.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PREPARED = bytes(10 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))


class _Starts(dict):
    """Whether a word starts a chunk; depends on the word alone, so equal passages are cut alike."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) > HELD:
            self.clear()
        self[word] = zlib.crc32(word) % TRIGGER == 0
        return self[word]


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased; pieces without words are left out."""
    for piece in text.encode().translate(_PREPARED).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def chunks(words: list[bytes], starts: dict[bytes, bool], overlap: int) -> Iterator[bytes]:
    """A piece as overlapping chunks.

    A chunk runs from one trigger word to the next and ``overlap`` words beyond; past the end
    of the piece end signs stand there. The others are its own: an n-gram of at most ``overlap + 1`` words
    belongs to the one chunk in whose own words it begins, and lies wholly inside it.
    """
    cuts = [0]
    for i, w in enumerate(words):
        if i and (starts[w] or i - cuts[-1] == LONGEST):
            cuts.append(i)
    n = len(words)
    words = words + [END.encode()] * overlap
    for a, b in zip(cuts, cuts[1:] + [n]):
        yield b" ".join(words[a : b + overlap])


def parse(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The dictionary of the parse: ``lang, chunk, times`` for every distinct chunk of a language and how often the parse holds it.

    NULL languages count as ``und``, NULL texts as empty. Tasks add up chunks in a table of
    bounded size, so a passage in thousands of copies is few rows before the shuffle; only
    ``lang`` and ``text`` of ``docs`` are read.
    """
    overlap = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, held = _Starts(), _Held("chunk")
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = [c for words in pieces(text or "") for c in chunks(words, starts, overlap)]
                # One decoding for a text: no word holds a line end.
                held.add(lang, b"\n".join(found).decode().split("\n") if found else [], repeat(1))
                if held.full():
                    yield held.emptied()
        yield held.emptied()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    found = texts.mapInArrow(run, "lang string, chunk string, times bigint")
    return found.groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


class _Held:
    """Counts per language and text, added up in a table of bounded size."""

    def __init__(self, name: str):
        self.counts: dict[str, dict[str, int]] = {}
        self.names = ["lang", name, "times"]
        self.size = self.entries = 0

    def add(self, lang: str, texts: list[str], times: Iterable[int]) -> None:
        own = self.counts.setdefault(lang, {})
        known, before = own.get, len(own)
        for text, n in zip(texts, times):
            own[text] = known(text, 0) + n
        added = len(own) - before
        if added:
            self.entries += added
            self.size += added * sum(map(len, texts)) // len(texts)

    def full(self) -> bool:
        return self.size > HELD_BYTES or self.entries > HELD

    def emptied(self) -> pa.RecordBatch:
        langs = [lang for lang, own in self.counts.items() for _ in own]
        texts = [t for own in self.counts.values() for t in own]
        times = [n for own in self.counts.values() for n in own.values()]
        self.counts, self.size, self.entries = {}, 0, 0
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(times, pa.int64())], names=self.names)


class _Placed(NamedTuple):
    """The words of a batch of chunks, chunk after chunk; arrays have a value for each word."""

    langs: list[str]
    names: list[str]
    lang: np.ndarray
    code: np.ndarray
    times: np.ndarray
    own: np.ndarray
    pair: np.ndarray
    bucket: np.ndarray


def _crc(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint64)


def _placed(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[_Placed]:
    """Batches of chunks as arrays: ``lang`` and ``code`` point into ``langs`` and ``names``.

    ``own`` marks a chunk's own words, ``pair`` those followed by a word in their piece, and
    ``bucket`` is where the pair of the two words is counted. A word is hashed once per batch.
    """
    for batch in groups(batches, 4 << 20):
        if not batch.num_rows:
            continue
        split = pc.split_pattern(batch.column("chunk").cast(pa.large_string()), " ")
        coded, langs = split.values.dictionary_encode(), batch.column("lang").dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        sizes, ends = np.diff(offsets), offsets[1:]
        # A cut within the last words of a piece leaves fewer than ``overlap`` end signs in the chunk before it.
        signs = np.add.reduceat(code == (names.index(END) if END in names else -1), offsets[:-1], dtype=np.int64)
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        place = np.arange(len(code))
        own = place < np.repeat(ends - overlap, sizes)
        pair = place + 1 < np.repeat(ends - signs, sizes)
        h = _crc(names)[code]
        mixed = (h * _MIX[0] + np.roll(h, -1) + _crc(langs.dictionary.to_pylist())[lang]) * _MIX[1]
        bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        yield _Placed(langs.dictionary.to_pylist(), names, lang, code, np.repeat(batch.column("times").to_numpy(), sizes), own, pair, bucket)


def _distinct(keys: np.ndarray, below: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; without a sort if all are less than ``below``."""
    if below is None:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(below, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[keys]


def busy_buckets(parsed: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> bytes:
    """A bitmap of ``2 ** BUCKET_BITS`` bits: the buckets whose pairs of words occur at least ``least`` times together.

    Every pair of words is counted in the bucket of its hash, so a frequent pair is always in
    a busy bucket. The bitmap has one size for any input; the fuller the buckets, the less
    it sorts out, and nothing else depends on it. Tasks hand on compressed blocks of
    counters that stop at ``least`` (or 255).
    """
    overlap, stop = max_words - 1, min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << BUCKET_BITS, np.uint8)
        for rows in _placed(batches, overlap):
            counted = rows.own & rows.pair
            # Bucket and count in one number: a sort of plain numbers is several times faster than one that keeps places.
            both = np.sort(rows.bucket[counted] << 8 | np.minimum(rows.times[counted], stop))
            bucket = both >> 8
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            if len(first):
                sums, found = np.add.reduceat(both & 255, first), bucket[first]
                counters[found] = np.minimum(counters[found] + sums, stop)
        for i, block in enumerate(counters.reshape(BLOCKS, -1)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(block, 1)], pa.binary())], names=["block", "counters"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << BUCKET_BITS) // BLOCKS, np.uint16)
        for counters in group.column("counters"):
            total = np.minimum(total + np.frombuffer(zlib.decompress(counters.as_py()), np.uint8), stop)
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(total >= stop).tobytes()], pa.binary())})

    blocks = parsed.mapInArrow(count, "block int, counters binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    bits = {r["block"]: r["bits"] for r in blocks.collect()}
    nothing = bytes((1 << BUCKET_BITS) // BLOCKS // 8)
    return b"".join(bits.get(i, nothing) for i in range(BLOCKS))


def phrase_counts(parsed: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, f``: every run of 1 to ``max_words`` words that occurs at least ``least`` times.

    N-grams are taken from the distinct chunks of :func:`parse` and weighed by how often
    each occurs; they begin in a chunk's own words, so no overlap counts twice. The row of the
    empty phrase has a language's number of words. A phrase is only as frequent as its
    rarest pair of neighbours, so n-grams with a pair outside :func:`busy_buckets` are not
    counted: most of them, and none that could be frequent. ``parsed`` is read twice.
    """
    overlap = max_words - 1
    busy = parsed.sparkSession.sparkContext.broadcast(busy_buckets(parsed, max_words, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = np.frombuffer(busy.value, np.uint8), _Held("phrase")
        for rows in _placed(batches, overlap):
            link = rows.pair & (bits[rows.bucket >> 3] >> (7 - (rows.bucket & 7)).astype(np.uint8) & 1).astype(bool)
            at, size = np.flatnonzero(rows.own), len(rows.names)
            # An n-gram's code is its place among the batch's distinct ones; the empty phrases of the languages are the first.
            code, texts, lang = rows.lang[at], [""] * len(rows.langs), np.arange(len(rows.langs))
            for n in range(max_words + 1):
                if n > 1:
                    goes_on = link[at + n - 2]
                    at, code = at[goes_on], code[goes_on]
                if n:
                    found, code = _distinct(code * size + rows.code[at + n - 1], len(rows.langs) * size if n == 1 else None)
                    head, tail = found // size, found % size
                    texts = [f"{texts[i]} {rows.names[j]}" if n > 1 else rows.names[j] for i, j in zip(head.tolist(), tail.tolist())]
                    lang = lang[head]
                sums = np.bincount(code, weights=rows.times[at], minlength=len(texts)).astype(np.int64).tolist()
                ends = np.searchsorted(lang, np.arange(len(rows.langs) + 1)).tolist()
                for name, i, j in zip(rows.langs, ends, ends[1:]):
                    if j > i:
                        held.add(name, texts[i:j], sums[i:j])
            if held.full():
                yield held.emptied()
        yield held.emptied()

    found = parsed.mapInArrow(run, "lang string, phrase string, times bigint").groupBy("lang", "phrase").agg(F.sum("times").alias("f"))
    words = F.when(F.col("phrase") == "", F.lit(0)).otherwise(F.size(F.split("phrase", " ", -1)))
    return found.where(F.col("f") >= least).select("lang", "phrase", words.alias("words"), "f")


def _words(phrase: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), start, length), " ")


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exact to counts of 15 digits."""
    whole = [c.cast("decimal(15,0)") for c in (a, left, right)]
    scaled = (whole[0] * whole[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled, whole[1] * whole[2])


def weakest_cuts(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every phrase of two or more words in ``counts``.

    The cut with the lowest score counts, the earliest of equal ones. Both parts of a
    frequent phrase are at least as frequent, so ``counts`` holds them.
    """
    counts = counts.where("words > 0")
    long = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", _words(F.col("phrase"), F.lit(1), F.col("k")))
    cuts = cuts.withColumn("rest", _words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    first = counts.select(F.col("lang").alias("first_lang"), F.col("phrase").alias("first_of"), F.col("f").alias("l"))
    rest = counts.select(F.col("lang").alias("rest_lang"), F.col("phrase").alias("rest_of"), F.col("f").alias("r"))
    met = cuts.join(first, (F.col("lang") == F.col("first_lang")) & (F.col("first") == F.col("first_of")))
    met = met.join(rest, (F.col("lang") == F.col("rest_lang")) & (F.col("rest") == F.col("rest_of")))
    met = met.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = met.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def independent(scored: DataFrame, percent: int = 50) -> DataFrame:
    """``scored`` without phrases inside a longer one that occurs at least ``percent`` per cent as often."""
    longer = scored.where("words > 2").select("lang", "phrase", F.col("words").alias("m"), "a")
    inner = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)))
    inner = inner.groupBy(F.col("lang").alias("in_lang"), _words(F.col("phrase"), F.col("i"), F.col("n")).alias("inner"))
    inner = inner.agg(F.max("a").alias("most"))
    covered = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent
    on = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & covered
    return scored.join(inner, on, "left_anti")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, percent: int = 50, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are the runs without space and tab between ``.,;:!?`` and line ends, A-Z
    lower-cased; ``n`` counts a language's words, ``a`` a phrase's occurrences, overlaps
    included, ``l`` and ``r`` those of the two parts at its weakest cut. Phrases of 2 to
    ``max_words`` words with ``a >= least`` are ranked by score, count and bytes; one inside
    a longer candidate with ``percent`` per cent of its count is left out. NULL languages
    are ``und``, NULL texts empty; repeated rows count as often as they occur; texts of any
    length are parsed whole; without words, or in an empty table, there are no rows.
    """
    parsed = materialise(parse(docs, max_words), "phrase_chunks")
    counts = materialise(phrase_counts(parsed, max_words, least), "phrase_counts")
    totals = counts.where("words = 0").select(F.col("lang").alias("of_lang"), F.col("f").alias("n"))
    scored = materialise(weakest_cuts(counts), "phrase_scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = independent(scored, percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = best.join(totals, F.col("lang") == F.col("of_lang"))
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs)


OP11_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), f AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM g, (VALUES (1), (2), (3)) x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}
), c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, words)) AS k FROM f WHERE words > 1
), q AS (
  SELECT c.lang, c.phrase, c.words, a, k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1:], ' ')
), b AS (
  SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), t AS (
  SELECT lang, a, string_split(phrase, ' ') AS s FROM b WHERE words = 3
), i AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, array_to_string(s[1:2], ' ') AS phrase FROM t UNION ALL SELECT lang, a, array_to_string(s[2:3], ' ') FROM t)
  GROUP BY lang, phrase
), o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * most < 50 * a
)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {TOP}
"""
