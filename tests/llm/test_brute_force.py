"""Registered queries against plain Python on the smallest tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from skyledger.llm import QUERIES, TWINS
from skyledger.llm import common, licenses, mixing, packing, pii, rules, winnow


@pytest.fixture(scope="module")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(TWINS))
def test_twin(spark, duck, sf, name):
    from oracle import compare

    assert compare(QUERIES[name](spark, sf), duck, TWINS[name]) is None


def test_simhash_classes(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf, "op1_simhash")}
    assert got == brute.near_duplicate_classes(list(texts.items()))


def test_rule_statistics(spark, sf, texts):
    for r in rows(spark, sf, "op4_quality_rules"):
        if len(texts[r.doc_id]) < 8000:
            n, chars, symbols, dup, repeated, failed = brute.base_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeated, failed)
        assert not (r.kept and r.base_failed)


def test_weighed_rules_beat_each_rule():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.85, 0.6, 0.75])
    votes = np.where(rng.random((20_000, 4)) < 0.2, 0, np.where((rng.random((20_000, 4)) < right) == truth[:, None], 1, 2))
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = rules.expectation_maximisation(patterns, counts.astype(float))
    assert ((post[place.ravel()] >= 0.5) == truth).mean() > 0.93


@pytest.mark.parametrize("name,label,n,held,least", [("op2_quality", "quality", 4, 2, 0.9), ("op5_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, n, held, least):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    truth = dict(zip(t["doc_id"], t[label]))
    hit = total = 0
    for r in rows(spark, sf, name):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held)
        if r.held_out and r.doc_id in truth:
            hit, total = hit + (r.predicted == truth[r.doc_id]), total + 1
    assert total > 50 and hit / total >= least


def test_base_spans(spark, sf, texts):
    for r in rows(spark, sf, "op8_pii"):
        want = brute.base_spans(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == q for k, _, _ in want) for q in brute.PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans)
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f x@y@z.org .@-.- a@b a@b. me@x.y.z..w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 9.9.9",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12345678901234567890 0 00 000000000000", "+1 (2) 3 +12345678 +1 234 567 89 (++1234567890 +1-",
        "+49 4111111111111111 1.1.1.1@a.b " * 400, "é\U0001f600+1 222 333 4444你4111111111111111",
    ],
)
def test_spans_of_hard_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.with_spans(pii.with_candidates(df), pii.Selector()).selectExpr("__base").first()[0]
    assert [(pii.KINDS[s.kind], s.start, s.end) for s in found] == brute.base_spans(text)


def test_long_runs_neither_recurse_nor_rescan(spark):
    text = "7" * 200_000 + " " + "a." * 100_000 + " +" + "1 " * 100_000 + "b" * 200_000 + "@"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.op8(df).count() == 1


def test_edited_texts(spark, sf, texts):
    want = brute.edited(list(texts.items()))
    got = rows(spark, sf, "op10_winnowing")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(f) == 1 for f in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_every_row_has_its_neighbour(spark):
    """Rows without an id and rows that share one, in two orders, against plain Python."""
    texts = [
        (7, "the first of two texts under one number, some words long"), (7, "the second text under that number is another one"), (3, None), (4, ""),
        (8, "three equal rows of ten words or a few more than that"), (8, "three equal rows of ten words or a few more than that"),
        (8, "three equal rows of ten words or a few more than that"), (None, "no number at all"), (None, "no number at all"), (None, "nor here, yet more words follow it"),
        (9, "你好世界 and some 漢字かな text, " * 5), (10, "a b c d e f g h i j k l m n o p q r s t"), (11, "a b c d e f g h i j k l m n o p q r s x"),
    ]
    want = brute.winnowed_neighbours(texts)
    for order in (texts, texts[::-1]):
        got = winnow.op10(spark.createDataFrame(order, "doc_id long, text string").repartition(4)).collect()
        seen = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
        assert sorted(seen, key=repr) == sorted(want, key=repr)


def test_winnowing_keeps_rightmost_minimum_and_its_guarantee(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(map(str, rng.integers(0, 50, winnow.GRAM + winnow.WINDOW - 1)))
    texts = [" ".join(map(str, rng.integers(0, 6, 40))) + f" {passage} " + " ".join(map(str, rng.integers(0, 6, k))) for k in (0, 1, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = df.select("doc_id", winnow.gram_hashes(df.text).alias("g"), winnow.positions(winnow.selected(df.text)).alias("k")).collect()
    for r in table:
        want = sorted({max(i for i in range(s, s + winnow.WINDOW) if r.g[i] == min(r.g[s : s + winnow.WINDOW])) for s in range(len(r.g) - winnow.WINDOW + 1)})
        assert [(x.position, x.hash) for x in r.k] == [(i, r.g[i]) for i in want]
    kept = [{x.hash for x in r.k} for r in table]
    assert set.intersection(*kept)


def test_packing_round_trip(spark, sf, texts):
    encode = packing.ChunkEncoder(packing.tokenizer_path())
    want = {i: np.frombuffer(encode.whole(t), "<u4").tolist() + [packing.END_ID] for i, t in texts.items()}
    pieces = rows(spark, sf, "op9_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, parts in by_doc.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == list(np.cumsum([0] + [p[2] for p in parts[:-1]]))
        assert sum(p[2] for p in parts) == len(want[i]) and all(p[2] == 1024 for p in parts[1:])
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) <= 1024
    total = sum(r.length for r in pieces)
    assert len(by_sequence) <= math.ceil(total / 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_every_bin_in_order(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [30, 120, 400, 1025, 1025, 342][seed], 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan, bins = packing.plan_bins(counts)
    content = defaultdict(list)
    for s, first, items, per_bin, start, offset in plan.tolist():
        for i in range(items):
            content[start + i // per_bin].append((offset + i % per_bin * s, s))
    assert sum(map(len, content.values())) == 3000 and len(content) == bins
    for parts in content.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [s for _, s in parts[:-1]])) and sum(s for _, s in parts) <= 1024
        assert sum(3 * s > 1024 for _, s in parts) <= 2
    assert bins <= max(math.ceil(sizes.sum() / 1024) * 1.02 + 1, (2 * sizes > 1024).sum() * 1.25)


def test_chunks_encode_like_whole_texts(texts):
    import pyarrow as pa

    encode = packing.ChunkEncoder(packing.tokenizer_path(), packing.ranks_path())
    rng = np.random.default_rng(1)
    letters = list("ab \n\t.,'!é1 s 　中#|'s  \r\x1c<|endoftext|>")
    odd = ["".join(rng.choice(letters, rng.integers(0, 16))) for _ in range(4000)]
    every = list(texts.values()) + odd
    for text, ids in zip(every, encode.encode_many(pa.array(every))):
        assert ids == encode.whole(text), repr(text[:80])


def test_counts_follow_edits(spark, sf, texts):
    from skyledger.llm.token_counts import CountTree

    encode = packing.encoder(packing.tokenizer_path(), packing.ranks_path())
    rng = np.random.default_rng(4)
    letters = list("ab  \n.,'é1 s 中#")
    for text in [*list(texts.values())[:80], "", "a", " ", "  ", " x y  z \n q"]:
        tree = CountTree(text, encode)
        for _ in range(6):
            tree.edit(int(rng.integers(0, len(tree.text) + 3)), int(rng.choice([0, 1, 2, 40, 700])), "".join(rng.choice(letters, rng.choice([0, 1, 7, 300]))))
            assert tree.total == len(encode.whole(tree.text)) // 4 and tree.chars[1] == len(tree.text)
    for r in rows(spark, sf, "op6_token_counts"):
        assert r.n_tokens == len(encode.whole(texts[r.doc_id])) // 4


def test_mix_comes_near_its_targets(spark):
    got = rows(spark, "/root/testdata/sf0.01", "op7_mix")
    by = defaultdict(list)
    for r in got:
        by[r.target, r.source_size].append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(r.size for r in got)
    assert sum(t for t, _ in by) == pytest.approx(1.5 * total)
    for (target, _), part in by.items():
        assert abs(sum(r.taken for r in part) - target) <= 0.03 * target + 2


def test_mix_draws_a_giant_by_seed(spark):
    docs = spark.createDataFrame([(0, "a", 400)] + [(i, "a", 1) for i in range(1, 601)], "doc_id long, source string, size long")
    drawn = set()
    for seed in range(8):
        got = {r.doc_id: r.copies for r in mixing.mix(docs, seed=seed).collect()}
        drawn.add(got[0])
        assert len(got) == 601 and set(got.values()) <= {0, 1, 2}
        assert abs(sum(n * (400 if i == 0 else 1) for i, n in got.items()) - 1500) <= 2
    assert drawn == {1, 2}


def test_license_cosine(spark):
    header = "Licensed under the Apache License, Version 2.0"
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "plain words " * 30), ("a/b/d.txt", "more words " * 30 + "\n# " + header + ", see there"),
        ("z/e.txt", "words " * 40), ("a/b/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), ("a/f.txt", "x"), (None, None),
    ]
    df = spark.createDataFrame(files, "file string, text string")
    got = {r.file: (r.license, r.how, r.licensed_by) for r in licenses.scan(df).collect()}
    assert got["a/LICENSE"] == ("MIT", "file", "a/LICENSE") and got["a/f.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/c.txt"] == ("GPL-3.0", "inherited", "a/b/LICENSE.md") and got["a/b/d.txt"] == ("Apache-2.0", "header", "a/b/d.txt")
    assert got["z/e.txt"] == (None, None, None) and got[""] == (None, None, None)


def test_license_belongs_to_its_row(spark):
    mit, prose = "Released under the MIT License", "plain prose that says nothing of the kind"
    df = spark.createDataFrame([(None, mit), (None, prose), (7, mit), (7, prose), (7, mit)], "doc_id long, text string")
    got = licenses.op3(df.selectExpr("*", "'s' AS source", "'en' AS lang")).collect()
    # What a row states is its own; a row with a path still inherits from the directory, one without has none.
    assert sorted((str(r.doc_id), str(r.license), str(r.how)) for r in got) == [
        ("7", "MIT", "file"), ("7", "MIT", "file"), ("7", "MIT", "inherited"), ("None", "MIT", "file"), ("None", "None", "None")
    ]


def test_sample_passes_over_very_long_texts(spark):
    rows = [(i, "word " * 10 if i % 17 else "x" * 20_000_000) for i in range(1, 301) if i % 17 or i == 17]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    got = common.labelled_sample(docs, marks, "toxic", 5, 0, 6_000, 20_000_100)
    want = [i for i, t in rows if zlib.crc32(str(i).encode()) % 5 and len(t) < 1_000]
    assert len(got) == len(want) and {label for _, label in got} == {0, 1}
    assert len(common.labelled_sample(docs, marks, "toxic", 5, 0, 6_000, 505)) == 10


def test_every_numbered_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert xxhash.xxh64(b"a", seed=42).intdigest() != 0 and common.WORD == brute.WORDS.pattern
