"""Token counts that follow edits: a segment tree of encoded runs per document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import ChunkEncoder, encoder, ranks_path, tokenizer_path

#: A leaf holds at least so many characters, and ends before a space between two other characters.
LEAF = 192


class CountTree:
    """The token count of a text, kept right under edits.

    Leaves are stretches of the text cut where no pre-token can cross: before a single
    space between two characters that are not white space. Nodes hold the characters and
    tokens below them, so a leaf is found, and a changed leaf accounted for, along one
    path. An edit re-encodes from the last cut that it cannot have touched to the next one.
    """

    def __init__(self, text: str, encode: ChunkEncoder):
        self.encode, self.text, self.reencoded, self.touched = encode, text, 0, 0
        pieces = self._cut(text)
        self.width = 1
        while self.width < len(pieces):
            self.width *= 2
        self.leaves = len(pieces)
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, piece in enumerate(pieces):
            self.chars[self.width + i] = len(piece)
            self.tokens[self.width + i] = self._count(piece)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _count(self, piece: str) -> int:
        return self.encode.count(piece)

    @staticmethod
    def _cut(text: str) -> list[str]:
        out, start, at = [], 0, LEAF
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                break
            if text[at - 1].isspace() or text[at + 1].isspace():
                at += 1
                continue
            out.append(text[start:at])
            start, at = at, at + LEAF
        return [*out, text[start:]]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if position >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node, start

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` on (both cut to the text) by ``inserted``."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(start + removed, n))
        # A cut at p stands on the characters p - 1, p and p + 1; it holds if none of them changed.
        first, left = self._leaf_at(max(0, start - 2)) if n else (self.width, 0)
        last, right = self._leaf_at(min(n - 1, end)) if n else (self.width, 0)
        right += self.chars[last]
        if right < n and right - 1 < end:
            last, right = self._leaf_at(right)
            right += self.chars[last]
        self.text = self.text[:start] + inserted + self.text[end:]
        region = self.text[left : right + len(inserted) - (end - start)]
        self.reencoded += len(region)
        for node in range(first, last + 1):
            self.chars[node], self.tokens[node] = (len(region), self._count(region)) if node == first else (0, 0)
        low, high = first, last
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self._sum(node)
                self.touched += 1


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of every document before and after its edits.

    ``docs`` has ``doc_id``, ``text`` and ``edits``, an array of ``(start, removed,
    inserted)`` applied in order, each to the text the one before it left. Result:
    ``doc_id, n_tokens, edited_tokens, edited_chars, n_leaves, reencoded_chars,
    updated_nodes``. A NULL text is empty, NULL edits are none; edits beyond the end are
    cut to the text. Repeated rows each get a row; an empty table gives none.
    """
    path, ranks = (path, None) if path else (tokenizer_path(), ranks_path())
    names = ["n_tokens", "edited_tokens", "edited_chars", "n_leaves", "reencoded_chars", "updated_nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                tree = CountTree(text or "", encode)
                before = tree.total
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((before, tree.total, len(tree.text), tree.leaves, tree.reencoded, tree.touched))
            if rows:
                arrays = [batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    kept = docs.select("doc_id", "text", "edits")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def revised(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits a text, all from its own row: a middle passage replaced by the text's beginning, another cut out, the source appended."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text).cast("bigint")
    edit = lambda start, removed, inserted: F.struct(
        start.cast("bigint").alias("start"), F.lit(removed).cast("bigint").alias("removed"), inserted.alias("inserted")
    )
    edits = F.array(
        edit(F.floor(n / 3), 16, F.substring(text, 1, 40)),
        edit(F.floor(2 * n / 3), 9, F.lit("")),
        edit(n + 64, 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
    )
    return docs.select("doc_id", text.alias("text"), edits.alias("edits"))


def op6(docs: DataFrame) -> DataFrame:
    return counts(revised(docs))
