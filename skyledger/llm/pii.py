"""Personal data: span candidates, boosted trees over format and context, calibrated thresholds.

Built-in column functions only: trees are fitted by Spark's own learner and applied
as nested CASE expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import tree_nodes

#: Kinds in their order within one start. The first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
BASE = KINDS[:4]

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base patterns, fixed, in forms that neither recurse nor rescan a long run: a run is entered
#: at its first character or where the last match ended, and is never given back where that cannot help.
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: written-out addresses, numbers without a country code, long number runs, keys, ids.
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?", r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}{_AT}{_LABEL}{{1,63}}(?:{_DOT}{_LABEL}{{1,63}}){{1,4}}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_])",
}
_WIDE_ANY = "|".join(f"(?:{p})" for p in WIDE.values())
_CUE = (
    r"(?i)(?:e-?mail|mail|contact|tele?|phone|call|fax|mobile|card|visa|credit|account|iban|ssn|social|"
    r"token|key|secret|passw(?:or)?d|pwd|auth|bearer|host|server|ip)\W{0,6}$"
)
FEATURES = [
    "kind", "wide", "checks", "chars", "digits", "letters", "upper", "variety", "cue", "assigned", "quoted",
    "glued_before", "glued_after",
]
#: Weight of all candidates together; every wide kind has an equal share of it, and all base candidates together have one.
TOTAL = 12_000
#: A kind with fewer rows to set its threshold takes the one of all wide kinds together, or ``FALLBACK`` without any.
ENOUGH, FALLBACK = 20, 0.5


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _before(values: Column, join: Callable[[Column, Column], Column], zero: Column, block: int = 256) -> Column:
    """``join`` of all values before each one, from ``zero`` on; in blocks, so that long arrays stay cheap."""

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def use(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return _bound(blocks, lambda bs: _bound(
            scan(F.transform(bs, lambda b: F.aggregate(b, zero, join))),
            lambda sums: F.flatten(F.transform(bs, lambda b, i: F.transform(F.slice(scan(b), F.lit(1), F.size(b)), lambda x: join(x, sums[i])))),
        ))

    return F.when(F.size(values) > 0, _bound(values, use)).otherwise(F.array().cast("array<bigint>"))


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _checks(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _share(match: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(match, f"[^{chars}]", "")) / F.length(match)


def _spans(parts: Column, matches: Column, describe: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``describe(start, match, before, after)`` of every match, from the text between matches."""
    taken = F.transform(matches, lambda m, i: (F.length(m) + F.length(parts[i])).cast("bigint"))
    starts = _before(taken, lambda a, b: a + b, F.lit(0).cast("bigint"))

    def use(at: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: describe(at[i] + F.length(parts[i]), m, F.substring(parts[i], -32, 32), F.substring(parts[i + 1], 1, 8)),
        )

    return _bound(starts, use)


def _candidate(kind: Column, wide: int, checks: Column, start: Column, m: Column, before: Column, after: Column) -> Column:
    double = lambda c: c.cast("double")
    return F.struct(
        start.alias("start"), kind.cast("int").alias("kind"), (start + F.length(m)).alias("end"),
        F.lit(wide).alias("wide"), checks.cast("int").alias("checks"), double(F.length(m)).alias("chars"),
        _share(m, "0-9").alias("digits"), _share(m, "A-Za-z").alias("letters"), _share(m, "A-Z").alias("upper"),
        (F.size(F.array_distinct(F.split(m, ""))) / F.length(m)).alias("variety"),
        double(before.rlike(_CUE)).alias("cue"), double(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        double(before.rlike(r"[\"'<(\[]$")).alias("quoted"), double(before.rlike(r"[\p{L}\p{N}]$")).alias("glued_before"),
        double(after.rlike(r"^[\p{L}\p{N}]")).alias("glued_after"),
    )


def _wide_kind(m: Column) -> Column:
    out = F.lit(KINDS.index("secret"))
    for kind, pattern in reversed([x for x in WIDE.items() if x[0] != "secret"]):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(KINDS.index(kind))).otherwise(out)
    return out


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__cands``: every base match, valid or not, and every wide one. NULL texts have none."""
    names = [*BASE, "wide"]
    patterns = [*BASE_PATTERNS.values(), _WIDE_ANY]
    kept = docs.columns
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*kept, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"__m_{n}") for n, p in zip(names, patterns)])
    none = F.array().cast("array<string>")
    cut = found.select(
        *kept, *[f"__m_{n}" for n in names],
        *[F.when(F.size(f"__m_{n}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"__p_{n}") for n, p in zip(names, patterns)],
    )

    def describe(n: str) -> Callable[[Column, Column, Column, Column], Column]:
        if n == "wide":
            return lambda s, m, b, a: _candidate(_wide_kind(m), 1, _checks("card", m), s, m, b, a)
        return lambda s, m, b, a: _candidate(F.lit(KINDS.index(n)), 0, _checks(n, m), s, m, b, a)

    arrays = [_spans(F.col(f"__p_{n}"), F.col(f"__m_{n}"), describe(n)) for n in names]
    found = cut.select(*kept, F.array_sort(F.concat(*arrays)).alias("__found"))
    return found.select(*kept, _with_touches(F.col("__found")).alias("__cands"))


def _with_touches(sorted_cands: Column) -> Column:
    """Sorted candidates, each with ``touches``: whether a valid base candidate overlaps it.

    Of those that start before it the furthest end decides, of those after it the nearest
    start: two running extremes instead of a look at every pair.
    """
    never = 1 << 62

    def use(cs: Column) -> Column:
        valid = lambda c: (c["wide"] == 0) & (c["checks"] == 1)
        ends = F.transform(cs, lambda c: F.when(valid(c), c["end"]).otherwise(F.lit(-1)).cast("bigint"))
        starts = F.transform(F.reverse(cs), lambda c: F.when(valid(c), c["start"]).otherwise(F.lit(never)).cast("bigint"))
        reached = _before(ends, lambda a, b: F.greatest(a, b), F.lit(-1).cast("bigint"))
        nearest = F.reverse(_before(starts, lambda a, b: F.least(a, b), F.lit(never).cast("bigint")))
        return _bound(reached, lambda r: _bound(nearest, lambda n: F.transform(
            cs, lambda c, i: c.withField("touches", ((r[i] > c["start"]) | (n[i] < c["end"])).cast("int"))
        )))

    return _bound(sorted_cands, use)


@dataclass
class Selector:
    """Trees as nested tuples ``(feature, threshold, left, right)`` or leaf values, their weights, and a threshold per kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        """Probability that a candidate is personal data."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(c[FEATURES[name]] <= threshold, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, tree in zip(self.weights, self.trees):
            margin = margin + weight * walk(tree)
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, c: Column) -> Column:
        """Valid base candidates always; others by their score, where a threshold could be set."""
        by_score = F.lit(False)
        if self.trees:
            score = self.score(c)
            for kind, threshold in self.thresholds.items():
                by_score = by_score | ((c["kind"] == kind) & (score >= threshold))
        return F.when(c["wide"] == 0, c["checks"] == 1).otherwise(by_score)


def _weak_label(c: str) -> str:
    """Base candidates by their checks; wide ones by a valid base span they overlap, their cue or their writing."""
    return (
        f"CASE WHEN {c}.wide = 0 THEN {c}.checks = 1 WHEN {c}.touches = 1 THEN true "
        f"WHEN {c}.kind = {KINDS.index('secret')} THEN {c}.cue + {c}.assigned >= 1 AND {c}.digits > 0.1 "
        f"WHEN {c}.kind = {KINDS.index('email')} THEN {c}.cue = 1 OR {c}.letters < 0.9 ELSE {c}.cue = 1 END"
    )


def fit(cands: DataFrame, sample: float = TOTAL, precision: float = 0.9, rounds: int = 10, depth: int = 4) -> Selector:
    """Fit trees and thresholds on every candidate of the table ``cands`` (``doc_id, __cands``).

    Candidates alike in features and label become one row that counts them. Every wide kind, and
    all base candidates together, have an equal share of the total weight ``sample``, so a rare kind
    weighs as much as a common one at any size. There are no labels for spans, so
    checks, overlaps with valid spans and cues serve as weak ones; format and context features carry them over to
    candidates without either. A third of the candidates, by a hash of place and features, sets, per kind, the lowest
    score at which ``precision`` of what is selected is labelled as data; a kind with fewer than
    ``ENOUGH`` candidates there takes the threshold of all wide kinds together, which weighs the kinds alike. Without
    both classes there is nothing to learn and base spans alone are selected.
    """
    rows = cands.where("size(__cands) > 0").select(F.explode("__cands").alias("c"))
    key = F.xxhash64("c.start", "c.end", *[f"c.{n}" for n in FEATURES])
    rows = rows.select(*[F.col(f"c.{n}").cast("double").alias(n) for n in FEATURES], F.expr(_weak_label("c")).cast("double").alias("label"), (F.pmod(key, F.lit(3)) == 0).alias("third"))
    rows = materialise(rows.groupBy(*FEATURES, "label", "third").agg(F.count("*").alias("n")), "pii_contexts")
    share = F.when(F.col("wide") == 1, F.col("kind")).otherwise(-1.0)
    totals = rows.groupBy(share.alias("share")).agg(F.sum("n").alias("n")).collect()
    each = F.create_map(*[F.lit(x) for r in totals for x in (r["share"], sample / (1 + len(WIDE)) / r["n"])]) if totals else F.lit(None)
    rows = rows.withColumn("weight", F.col("n") * each[share]) if totals else rows.withColumn("weight", F.lit(0.0))
    third = F.col("third")
    classes = rows.where(~third).groupBy("label").count().collect()
    if len(classes) < 2:
        return Selector()
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, weightCol="weight").fit(ready.where(~third))

    fitted = Selector([tree_nodes(t) for t in model.trees], list(model.treeWeights))
    row = F.struct(*FEATURES)
    scored = rows.where(third & (F.col("wide") == 1)).select("kind", "label", "n", "weight", (F.floor(fitted.score(row) * 1000) / 1000).alias("score"))
    per_kind: dict[int, list[tuple[float, int, float]]] = {}
    weighed: list[tuple[float, float, float]] = []
    sums = [F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("weight").alias("w"), F.sum(F.col("label") * F.col("weight")).alias("w_hits")]
    for r in scored.groupBy("kind", "score").agg(*sums).collect():
        per_kind.setdefault(int(r["kind"]), []).append((r["score"], r["n"], r["hits"]))
        weighed.append((r["score"], r["w"], r["w_hits"]))
    every = lowest_score(weighed, precision)
    for kind in map(KINDS.index, WIDE):
        steps = per_kind.get(kind, [])
        few = sum(n for _, n, _ in steps) < ENOUGH
        threshold = (FALLBACK if every is None else every) if few else lowest_score(steps, precision)
        if threshold is not None:
            fitted.thresholds[kind] = threshold
    return fitted


def lowest_score(steps: list[tuple[float, float, float]], precision: float) -> float | None:
    """The lowest score from which on ``precision`` of the rows are hits; ``steps`` are ``(score, rows, hits)``."""
    n = hits = 0
    lowest = None
    for score, more, right in sorted(steps, reverse=True):
        n, hits = n + more, hits + right
        if hits and hits >= precision * n:
            lowest = score
    return lowest


def with_spans(found: DataFrame, selector: Selector) -> DataFrame:
    """``found`` (from :func:`with_candidates`) with ``__base`` and ``__spans``: sorted arrays of (start, kind, end).

    Wide spans that overlap a base span give way to it.
    """
    kept = [c for c in found.columns if c != "__cands"]
    short = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.filter("__cands", lambda c: (c["wide"] == 0) & (c["checks"] == 1))
    spans = F.filter("__cands", lambda c: ((c["wide"] == 0) | (c["touches"] == 0)) & selector.accepts(c))
    return found.select(*kept, F.transform(base, short).alias("__base"), F.transform(spans, short).alias("__spans"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row; each span has ``start`` and ``end`` in code points and a ``kind`` index.

    Runs in three passes: candidates of all rows, one table; the fit on all of
    them; selection. NULL and empty texts have no spans, repeated rows each get a row,
    an empty table gives none.
    """
    cands = materialise(with_candidates(docs.select("doc_id", "text")).select("doc_id", "__cands"), "pii")
    out = with_spans(cands, fit(cands))
    return out.select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; ``n_chars`` follows.

    Spans that overlap become one, named after the first. NULL texts stay NULL.
    """
    names = docs.columns
    cands = materialise(with_candidates(docs.select("doc_id", "text")).select("doc_id", "__cands"), "pii")
    spans = with_spans(with_candidates(docs), fit(cands))
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    size = 512

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, out of blocks of it: a long text is not walked again for every span."""

        def part(k: Column) -> Column:
            low = F.greatest(start - k * size, F.lit(0))
            return F.substring(blocks[k.cast("int")], (low + 1).cast("int"), (F.least(end - k * size, F.lit(size)) - low).cast("int"))

        steps = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
        return F.when(end > start, F.array_join(F.transform(steps, part), "")).otherwise(F.lit(""))

    def rewrite(found: Column, blocks: Column) -> Column:
        ends = F.transform(found, lambda s: s["end"])

        def join(reached: Column) -> Column:
            # A span that starts before the furthest end so far belongs to the one before it.
            pieces = F.transform(
                found,
                lambda s, i: F.when(
                    s["start"] >= reached[i], F.concat(between(blocks, reached[i], s["start"]), label[s["kind"]])
                ).otherwise(F.lit("")),
            )
            return F.concat(F.array_join(pieces, ""), between(blocks, F.array_max(ends), F.length("text").cast("bigint")))

        return _bound(_before(ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint")), join)

    cut = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / size)), lambda k: F.substring(F.col("text"), (k * size + 1).cast("int"), F.lit(size))
    )
    clean = F.when(F.size("__spans") > 0, _bound(cut, lambda b: rewrite(F.col("__spans"), b))).otherwise(F.col("text"))
    out = spans.select(*[c for c in names if c not in ("text", "n_chars")], clean.alias("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op8(docs: DataFrame) -> DataFrame:
    out = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
