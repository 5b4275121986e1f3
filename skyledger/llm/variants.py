"""Spelling variants: pairs of words one edit apart, by composing the vocabulary with a one-edit transducer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Letters of a word, its least length and least count, and the factor by which a form must be more frequent.
LETTERS, LENGTH, LEAST, FACTOR = "A-Za-zÀ-ÿ", 5, 3, 2
#: A run loses a letter if this divides the CRC-32 of ``<doc_id>:<run>``.
DAMAGED = 97
#: Words of one initial state at most; states of more words are replaced by their successors.
STATE_WORDS = 8192
#: Ends a word inside an initial state, and stands for the edited letter in a key; no letter.
END, ANY = "$", "*"
#: Words a task adds up before it hands them on.
HELD = 200_000


def word_counts(docs: DataFrame, length: int = LENGTH, least: int = LEAST, damaged: int = DAMAGED) -> DataFrame:
    """``word, n`` of every word of at least ``length`` letters that occurs at least ``least`` times.

    A word is a longest run of letters with A-Z lower-cased, without the letter at
    ``h % length`` if ``damaged`` divides h, the CRC-32 of ``<doc_id>:<run>`` (a NULL id is
    the empty string). NULL texts have none. Tasks add up words in a table of bounded size.
    """
    runs = re.compile(f"[{LETTERS}]{{{length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emptied() -> pa.RecordBatch:
            cols = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                base = crc(f"{doc_id or ''}:".encode())
                # bytes.lower() changes A-Z only.
                found = runs.findall((text or "").encode().lower().decode())
                hashes = [crc(w.encode(), base) for w in found]
                hit = [i for i, h in enumerate(hashes) if h % damaged == 0]
                for i in hit:
                    at = hashes[i] % len(found[i])
                    found[i] = found[i][:at] + found[i][at + 1 :]
                held.update(found)
                for i in hit:
                    if len(found[i]) < length:
                        held[found[i]] = 0
                if len(held) > HELD:
                    yield emptied()
        if held:
            yield emptied()

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    counts = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) & (F.char_length("word") >= length))


def initial_states(words: DataFrame, bound: int = STATE_WORDS) -> DataFrame:
    """``word, n, start``: the shortest beginning of each word (and its end sign) that at most ``bound`` words share.

    The beginnings are states of the composition with no edit used yet. States with more
    words are found level by level, a block of levels in each round; only words below a
    crowded state take part in the next block.
    """
    ended = F.concat("word", F.lit(END))
    rest, low, step, crowded = words.select(ended.alias("ended")), 0, 8, None
    while True:
        levels = F.sequence(F.lit(low + 1), F.least(F.lit(low + step), F.char_length("ended")))
        begun = rest.where(F.char_length("ended") > low).select(
            F.explode(F.transform(levels, lambda k: F.substring(F.col("ended"), F.lit(1), k))).alias("begin")
        )
        more = begun.groupBy("begin").agg(F.count("*").alias("m")).where(F.col("m") > bound)
        more = materialise(more.select("begin", F.char_length("begin").alias("depth")), "variant_states")
        crowded = more if crowded is None else crowded.unionByName(more)
        last = more.where(F.col("depth") == low + step)
        if last.isEmpty():
            break
        rest = rest.join(last, F.substring(F.col("ended"), 1, low + step) == F.col("begin"), "left_semi")
        low, step = low + step, 2 * step
    deepest = crowded.agg(F.max("depth")).first()[0] or 0
    depth = F.lit(1)
    if deepest:
        begins = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.char_length(ended))), lambda k: F.substring(ended, F.lit(1), k))
        under = words.select("word", F.explode(begins).alias("b")).join(crowded, F.col("b") == F.col("begin"))
        under = under.groupBy(F.col("word").alias("of")).agg(F.max("depth").alias("depth"))
        words = words.join(under, F.col("word") == F.col("of"), "left")
        depth = F.coalesce("depth", F.lit(0)) + 1
    return words.select("word", "n", F.substring(ended, F.lit(1), depth).alias("start"))


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """The minimal deterministic acceptor of sorted distinct words: arcs and finality of every state, 0 the first.

    States left behind by the next word are final in form; one equal to an earlier state is replaced by it.
    """
    arcs: list[dict[str, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path, last = [0], ""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((final[state], tuple(arcs[state].items())), state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        settle(shared)
        for letter in word[shared:]:
            arcs[path[-1]][letter] = len(arcs)
            path.append(len(arcs))
            arcs.append({})
            final.append(False)
        final[path[-1]] = True
        last = word
    settle(0)
    return arcs, final


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of ``words`` (sorted, distinct) that differ by one replaced, inserted or deleted letter, each once.

    Enumerates the composition acceptor - one-edit transducer - acceptor. Before the edit
    both sides are in one state; the edit takes them apart (two different letters, or a
    letter on one side alone); after it both must accept the same rest. What begins at a
    state is found once and serves all ways to it; pairs of states without a common rest are
    remembered. Of an inserted letter in a run of equal ones the last is meant, so the rest
    never begins with it. Stacks are explicit: words may have any length.
    """
    arcs, final = acceptor(words)
    barren: set[tuple[int, int]] = set()

    def common(p: int, q: int, skip: str | None = None) -> Iterator[str]:
        """Rests accepted from both states that do not begin with ``skip``."""
        if (p, q) in barren:
            return
        path: list[str] = []
        frames = [(p, q, iter([c for c in arcs[p] if c != skip]))]
        fruit = [final[p] and final[q]]
        if fruit[0]:
            yield ""
        while frames:
            x, y, letters = frames[-1]
            for c in letters:
                y_next = arcs[y].get(c)
                if y_next is None or (arcs[x][c], y_next) in barren:
                    continue
                x_next = arcs[x][c]
                path.append(c)
                frames.append((x_next, y_next, iter(arcs[x_next])))
                fruit.append(final[x_next] and final[y_next])
                if fruit[-1]:
                    yield "".join(path)
                break
            else:
                frames.pop()
                bore = fruit.pop()
                if frames:
                    path.pop()
                    fruit[-1] |= bore
                if not bore and (frames or skip is None):
                    barren.add((x, y))

    def edits(q: int) -> list[tuple[str, str]]:
        """Pairs of rests from ``q`` whose edit comes first."""
        out = []
        letters = sorted(arcs[q])
        for i, c in enumerate(letters):
            for d in letters[i + 1 :]:
                out.extend((c + s, d + s) for s in common(arcs[q][c], arcs[q][d]))
            out.extend((c + s, s) for s in common(arcs[q][c], q, c))
        return out

    of_state: dict[int, list[tuple[str, str]]] = {}
    path: list[str] = []
    frames = [(0, None)]
    while frames:
        q, letters = frames.pop()
        if letters is None:
            letters = iter(arcs[q].items())
            if q not in of_state:
                of_state[q] = edits(q)
            if of_state[q]:
                begin = "".join(path)
                for a, b in of_state[q]:
                    yield begin + a, begin + b
        for c, state in letters:
            frames += [(q, letters), (state, None)]
            path.append(c)
            break
        else:
            if path:
                path.pop()


def near_pairs(words: DataFrame, bound: int = STATE_WORDS) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of words (``word, n``, distinct) exactly one edit apart, once.

    The composition is enumerated per initial state, see :func:`initial_states`: words that
    begin alike form one group of at most ``bound``. States whose edit lies within the
    beginning accept equal rests only, so they are equality joins: words with one letter of
    the beginning left open (a key has at most as many words as there are letters), and words
    without one of its letters against whole words.
    """
    states = materialise(initial_states(words, bound), "variant_words")

    def compose(group: pa.Table) -> pa.Table:
        counts = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        pairs = list(one_edit_pairs(sorted(counts))) if len(counts) > 1 else []
        return pa.table({
            "a": pa.array([a for a, _ in pairs], pa.string()), "a_n": pa.array([counts[a] for a, _ in pairs], pa.int64()),
            "b": pa.array([b for _, b in pairs], pa.string()), "b_n": pa.array([counts[b] for _, b in pairs], pa.int64()),
        })

    inside = states.groupBy("start").applyInArrow(compose, "a string, a_n bigint, b string, b_n bigint")

    word = F.col("word")
    places = F.sequence(F.lit(1), F.least(F.char_length("start"), F.char_length("word")))
    head = lambda i: F.substring(word, F.lit(1), i - 1)
    tail = lambda i: F.substring(word, i + 1, F.char_length(word))
    opened = states.select("word", "n", F.explode(F.transform(places, lambda i: F.concat(head(i), F.lit(ANY), tail(i)))).alias("key"))
    met = opened.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("w")).where(F.size("w") > 1)
    met = met.select("w", F.explode("w").alias("x")).select("x", F.explode("w").alias("y")).where(F.col("x.word") < F.col("y.word"))
    met = met.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))

    shorter = F.array_distinct(F.transform(places, lambda i: F.concat(head(i), tail(i))))
    cut = states.select(word.alias("a"), F.col("n").alias("a_n"), F.col("start").alias("a_start"), F.explode(shorter).alias("rest"))
    grown = cut.join(states, (F.col("rest") == F.col("word")) & (F.col("a_start") != F.col("start")))
    grown = grown.select("a", "a_n", F.col("word").alias("b"), F.col("n").alias("b_n"))
    return inside.unionByName(met).unionByName(grown)


def _last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of each chain of forms, by doubling.

    Each form is ``FACTOR`` times as frequent as its word, so a chain has no more steps than
    the largest count has binary digits, and as many rounds as that number has.
    """
    roots = materialise(forms.select("word", F.col("form").alias("root")), "variant_roots")
    while True:
        ahead = roots.select(F.col("word").alias("via"), F.col("root").alias("far"))
        moved = roots.join(ahead, F.col("root") == F.col("via"), "left")
        moved = materialise(moved.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("on")), "variant_roots")
        roots = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return roots


def spelling_groups(words: DataFrame, factor: int = FACTOR, bound: int = STATE_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (``word, n``, distinct words).

    ``form`` is the most frequent word one edit away, the first in code-point order of equal
    ones, if it is at least ``factor`` times as frequent; ``root`` the end of the chain of forms.
    """
    words = materialise(words.select("word", "n"), "variant_counts")
    pairs = materialise(near_pairs(words, bound), "variant_pairs")
    turned = pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    first = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("first")
    best = pairs.unionByName(turned).groupBy(F.col("a").alias("of")).agg(F.count("*").alias("n_near"), first)
    taken = -F.col("first.less") >= factor * F.col("n")
    out = words.join(best, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("first.near")).alias("form"), F.when(taken, -F.col("first.less")).alias("form_n"),
    )
    out = materialise(out, "variant_forms")
    roots = _last_forms(out.where("form is not null")).select(F.col("word").alias("of"), "root")
    return out.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def op13(docs: DataFrame) -> DataFrame:
    """NULL texts have no words, a NULL id is an empty string, repeated rows count as often as they occur, and
    words of any length take part; a table without words gives no rows."""
    return spelling_groups(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
