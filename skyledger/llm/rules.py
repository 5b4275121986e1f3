"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACES, per_text

SYMBOLS = "#*$%&|<>"
_BLANK = SPACES.encode()

#: Each rule: its name, and SQL over the statistics for a vote for quality and for a vote against; neither: it abstains.
RULES = [
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "n_symbols = 0", "20 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines = 0 AND n_lines >= 2", "5 * n_dup_lines > n_lines"),
    ("repeated_words", "20 * n_repeat_words < n_words", "4 * n_repeat_words > n_words"),
    ("letters", "n_letters >= 0.9 * word_chars", "n_letters < 0.8 * word_chars"),
    ("capitals", "n_upper < 0.1 * n_letters", "n_upper > 0.4 * n_letters"),
    ("plain_words", "n_plain >= 0.9 * n_words", "n_plain < 0.7 * n_words"),
    ("variety", "2 * n_distinct > n_words OR n_distinct > 150", "5 * n_distinct < n_words AND n_distinct < 100"),
]
STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_plain", "n_distinct",
]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    grams = list(zip(words, words[1:], words[2:]))
    first: dict[tuple, int] = {}
    again: set[int] = set()
    for i, gram in enumerate(grams):
        at = first.setdefault(gram, i)
        if at != i:
            again.add(at)
            again.add(i)
    if not again:
        return 0
    marks = np.zeros(len(words), bool)
    at = np.fromiter(again, np.int64, len(again))
    for k in range(3):
        marks[at + k] = True
    return int(marks.sum())


def _stats(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _LETTERS))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        upper,
        sum(w.strip(_MARKS).isalpha() for w in text.split()),
        len(set(words)),
    )


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = ".,;:!?\"'()"


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``STATS`` of every whole text; a NULL text has no words."""
    return per_text(docs, ", ".join(f"{n} bigint" for n in STATS), STATS, _stats)


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` with ``pattern``: the votes of ``RULES`` as one number, base 3 (0 abstains, 1 for, 2 against)."""
    code = F.lit(0)
    for _, good, bad in RULES:
        code = code * 3 + F.when(F.expr(good), 1).when(F.expr(bad), 2).otherwise(0)
    return stats.withColumn("pattern", F.when(F.col("n_words") > 0, code).otherwise(F.lit(-1)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of quality per pattern (rows of 0, 1, 2), weighted by ``counts``.

    Rules are taken as independent given the class; each has, per class, a rate of voting
    for, against or abstaining. The start is the majority vote, with rules better than
    chance, so the class named quality stays the one the rules vote for.
    """
    one = (patterns[:, :, None] == np.arange(3)).astype(float)
    post = np.clip(0.5 + 0.45 * (one[:, :, 1].sum(1) - one[:, :, 2].sum(1)) / np.maximum(1, (patterns > 0).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        good, bad = post * counts, (1 - post) * counts
        prior = (good.sum() + 1) / (counts.sum() + 2)
        rate = lambda w: (np.einsum("p,prv->rv", w, one) + 1) / (w.sum() + 3)
        log_good = np.einsum("prv,rv->p", one, np.log(rate(good))) + np.log(prior)
        log_bad = np.einsum("prv,rv->p", one, np.log(rate(bad))) + np.log(1 - prior)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-9:
            break
    return post


def posteriors(voted: DataFrame) -> DataFrame:
    """``vote_pattern, quality`` for every pattern in ``voted``.

    The rows are counted by pattern first, so what the driver weighs has at most
    ``3 ** len(RULES)`` rows at any size of the corpus. Equal texts have equal patterns
    and no group of them is ever gathered.
    """
    spark = voted.sparkSession
    rows = voted.where("pattern >= 0").groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in rows], np.int64)
    digits = codes[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1) % 3
    post = expectation_maximisation(digits, np.array([r["count"] for r in rows], float))
    table = [(int(c), float(p)) for c, p in zip(codes, post)] + [(-1, 0.0)]
    return spark.createDataFrame(table, "vote_pattern int, quality double")


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``STATS``, ``pattern`` and ``quality``, the posterior probability that the text is good, of every row.

    A text without words has quality 0. Repeated rows each get a row and count each; an
    empty table gives no rows.
    """
    voted = materialise(votes(statistics(docs)), "rule_votes")
    return voted.join(posteriors(voted), F.col("pattern") == F.col("vote_pattern")).drop("vote_pattern")


def op4(docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(docs).select(
        "doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality"
    )
