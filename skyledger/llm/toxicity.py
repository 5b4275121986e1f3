"""Toxicity: boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SAMPLE_BYTES, SAMPLE_ROWS, id_remainder, labelled_sample, tree_nodes

#: Insults that count from the start, and second-person words of the four languages.
SEED = set(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting clown "
    "imbecile cretin scumbag filth vermin freak degenerate jerk dumbass bastard bitch asshole retard".split()
)
SECOND_PERSON = set("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted tú ti vosotros".split())
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_EDGE = ".,;:!?\"'()[]{}<>*#%&|_-~`=+/\\"
_ODD = re.compile(r"[^\W\d_](?:[0-9@$!*|]+[^\W\d_])+|^[0-9@$!]+[^\W\d_]{2,}", re.UNICODE)
PREFIXES = (4, 5, 6)
#: Words of a text between an insult and a second-person word that still count as near.
NEAR = 5
#: Entries of a worker's table of classified words; beyond it the table is started anew.
MEMO_ENTRIES = 300_000
FEATURES = [
    "lexicon", "weight", "strongest", "hits", "prefixes", "seed", "near_you", "you", "capitals", "shouted", "exclaimed",
    "punctuation", "obfuscated", "length",
]


def plain(chunk: str) -> str:
    """A word in lower case without marks at its ends, with digits and signs inside it read as letters."""
    word = chunk.lower().strip(_EDGE)
    return word.translate(_PLAIN).replace("*", "") if word and not word.isalpha() else word


def terms(text: str) -> set[str]:
    """The words of a text, and beginnings of longer words as ``begin*``."""
    out = set()
    for chunk in set(text.split()):
        word = plain(chunk)
        if word:
            out.add(word)
            out.update(word[:k] + "*" for k in PREFIXES if len(word) > k)
    return out


def learn_lexicon(texts: list[str], toxic: list[int], support: int = 3, lift: float = 2.5, most: int = 4000) -> dict[str, float]:
    """Terms whose log ratio of document frequencies in toxic and other texts is at least ``lift``."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic):
        found[label].update(terms(text))
    n = [max(1, toxic.count(k)) for k in (0, 1)]
    scores = {
        t: math.log((c + 0.5) / (n[1] + 1)) - math.log((found[0][t] + 0.5) / (n[0] + 1)) for t, c in found[1].items() if c >= support
    }
    best = sorted((-s, t) for t, s in scores.items() if s >= lift)[:most]
    return {t: -s for s, t in best}


class Describer(dict):
    """The features of a text; remembers what each distinct word is."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> tuple | None:
        word = plain(chunk)
        weight = self.lexicon.get(word, 0.0)
        begin = max((self.lexicon.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k), default=0.0)
        seed, you = word in SEED, word in SECOND_PERSON
        shouted, odd = len(chunk) > 2 and chunk.isupper(), bool(_ODD.search(chunk.strip(_EDGE)))
        value = (weight, begin, seed, you, shouted, odd) if weight or begin or seed or you or shouted or odd else None
        self[chunk] = value
        return value

    def features(self, text: str) -> list[float]:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        words = text.split()
        marked = [(i, v) for i, v in enumerate(map(self.__getitem__, words)) if v]
        per = 100 / max(1, len(words))
        hits = [i for i, v in marked if v[0] or v[2]]
        yours = np.array([i for i, v in marked if v[3]] or [-(10**9)])
        near = 0
        if hits and len(yours):
            at = np.searchsorted(yours, hits)
            left, right = yours[np.maximum(at - 1, 0)], yours[np.minimum(at, len(yours) - 1)]
            near = int((np.minimum(np.abs(left - hits), np.abs(right - hits)) <= NEAR).sum())
        chars = max(1, len(text))
        return [
            len(hits) * per,
            sum(v[0] for _, v in marked) * per,
            max((max(v[0], v[1]) for _, v in marked), default=0.0),
            math.log1p(len(hits)),
            sum(v[1] > 0 for _, v in marked) * per,
            sum(v[2] for _, v in marked) * per,
            near * per,
            sum(v[3] for _, v in marked) * per,
            sum(map(str.isupper, text)) / chars,
            sum(v[4] for _, v in marked) * per,
            text.count("!") * 100 / chars,
            sum(map(text.count, ".,;:?*#%&|")) * 100 / chars,
            sum(v[5] for _, v in marked) * per,
            math.log1p(len(words)),
        ]


def _evaluate(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), float(node))
    feature, threshold, left, right = node
    return np.where(x[:, feature] <= threshold, _evaluate(left, x), _evaluate(right, x))


@dataclass
class Model:
    """Lexicon, trees with weights, and the isotonic steps from margin to probability."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((w * _evaluate(t, x) for w, t in zip(self.weights, self.trees)), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), self.bounds, self.values), 0.0, 1.0)


def fit_rows(spark: SparkSession, texts: list[str], toxic: list[int], rounds: int = 20, depth: int = 3) -> Model:
    """Fit on a bounded sample.

    Training features of each half come from the lexicon of the other half, so the trees
    do not trust words only because the row itself taught them. Trees are grown on two
    thirds of the rows; the isotonic steps come from the last third. With one class only,
    every text scores its share.
    """
    n = len(texts)
    if len(set(toxic)) < 2:
        share = float(np.mean(toxic)) if n else 0.0
        return Model(values=np.array([share]))
    rows: list[list[float]] = [[]] * n
    for half in (0, 1):
        other = [i for i in range(n) if i % 2 != half]
        describer = Describer(learn_lexicon([texts[i] for i in other], [toxic[i] for i in other], support=2 if n < 1000 else 3))
        for i in range(half, n, 2):
            rows[i] = describer.features(texts[i])
    grown = [i for i in range(n) if i % 3]
    data = [(float(toxic[i]), Vectors.dense(rows[i])) for i in grown]
    frame = spark.createDataFrame(data, ["label", "features"]).repartition(4, "label")
    trees, weights = [], []
    if len({toxic[i] for i in grown}) == 2:
        fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=7).fit(frame.coalesce(1))
        trees, weights = [tree_nodes(t) for t in fitted.trees], list(fitted.treeWeights)
    model = Model(learn_lexicon(texts, toxic, support=2 if n < 1000 else 3), trees, weights)
    rest = [i for i in range(n) if i % 3 == 0]
    margins = model.margin(np.array([rows[i] for i in rest], float).reshape(len(rest), len(FEATURES)))
    steps = spark.createDataFrame([(float(m), float(toxic[i])) for m, i in zip(margins, rest)], ["features", "label"])
    line = IsotonicRegression().fit(steps.coalesce(1))
    model.bounds, model.values = np.array(line.boundaries.toArray()), np.array(line.predictions.toArray())
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """The model from ``labels.toxic``; rows with crc32(doc_id) mod 5 = 0 are held out."""
    pairs = labelled_sample(docs, labels, "toxic", 5, 0, rows, size)
    return fit_rows(docs.sparkSession, [t for t, _ in pairs], [y for _, y in pairs])


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__toxicity``, the calibrated score of the whole ``text``; a NULL text counts as empty."""
    names = docs.columns
    shared: list[Describer] = []

    def run(batches):
        if not shared:
            shared.append(Describer(model.lexicon))
        for batch in batches:
            if batch.num_rows:
                x = np.array([shared[0].features(t or "") for t in batch.column("text").to_pylist()], float)
                arrays = [*batch.columns, pa.array(model.score(x))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "__toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__toxicity", DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns are kept."""
    return with_score(docs, fit(docs, labels)).where(F.col("__toxicity") < threshold).drop("__toxicity")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Repeated rows each get a row, rows without an id are scored too, an empty table gives none."""
    out = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__toxicity").alias("score"),
        F.when(F.col("__toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
