"""Text quality from compression with dictionaries built of good and of bad texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, SAMPLE_ROWS, id_remainder, labelled_sample, per_text

DICTIONARY = 96 * 1024
#: A text is compressed in blocks of so many bytes, so that the dictionary counts for long texts as for short ones.
BLOCK = 2048
LEVEL = 3


@dataclass
class Classifier:
    """Two dictionaries and the calibration: logistic weights over the size features, standardised by centre and scale."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        sizes = _sizer(self.good, self.bad)

        def score(text: str) -> float:
            x = (features(sizes, text) - self.centre) / self.scale
            return float(1 / (1 + np.exp(-np.clip(_terms(x) @ self.weights, -50, 50))))

        return score


def _sizer(good: bytes, bad: bytes):
    packers = [zstd.ZstdCompressor(level=LEVEL)]
    for content in (good, bad):
        entry = zstd.ZstdCompressionDict(content)
        entry.precompute_compress(level=LEVEL)
        packers.append(zstd.ZstdCompressor(level=LEVEL, dict_data=entry, write_content_size=False, write_dict_id=False))

    def sizes(raw: bytes) -> tuple[int, int, int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        plain, *rest = (sum(len(p.compress(b)) for b in blocks) for p in packers)
        return plain, *rest

    return sizes


def features(sizes, text: str) -> np.ndarray:
    """Normalised difference of the compressed sizes; bits a byte without and with the better dictionary."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(3)
    plain, good, bad = sizes(raw)
    return np.array([(bad - good) / max(good, bad), plain / len(raw), min(good, bad) / len(raw)])


def _terms(x: np.ndarray) -> np.ndarray:
    """The features, their squares and products, and a constant."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    pairs = [x[:, i] * x[:, j] for i in range(n) for j in range(i, n)]
    return np.stack([np.ones(len(x)), *x.T, *pairs], 1).squeeze()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' blocks; where there are too few for the builder, the blocks themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstd.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def fit_rows(texts: list[str], quality: list[int]) -> Classifier:
    """Dictionaries from two thirds of the rows, calibration from the other third, which they have not seen."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    y = np.array(quality, float)
    part = np.arange(len(raw)) % 3
    good, bad = (_dictionary([r for r, k, q in zip(raw, part, y) if k and q == c]) for c in (1, 0))
    sizes = _sizer(good, bad)
    rows = [i for i in range(len(raw)) if part[i] == 0]
    if not rows:
        return Classifier(good, bad, np.zeros(3), np.ones(3), np.zeros(10))
    x = np.stack([features(sizes, texts[i]) for i in rows])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    terms = np.atleast_2d(_terms((x - centre) / scale))
    return Classifier(good, bad, centre, scale, _logistic(terms, y[rows]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Classifier:
    """The classifier from ``labels.quality``; rows with crc32(doc_id) mod 4 = 2 are held out."""
    pairs = labelled_sample(docs, labels, "quality", 4, 2, rows, size)
    return fit_rows([t for t, _ in pairs], [q for _, q in pairs])


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text.

    A NULL or empty text scores like any text of no bytes. Repeated rows each get a row;
    an empty table gives none.
    """
    cache: list = []

    def score(text: str) -> tuple[float]:
        if not cache:
            cache.append(model.scorer())
        return (cache[0](text),)

    return per_text(docs, "score double", ["score"], score)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
