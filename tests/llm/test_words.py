"""Collocations, byte-level BPE and spelling variants against plain Python, with odd rows and forced splits."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_edges import CLASHING, ROWS, SCHEMA

from skyledger.llm import QUERIES, bpe, collocations, variants


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    names = CLASHING + "word start n form root ids decoded chunk own times phrase words rank l r a b lang_ key k begin of".split()
    return df.select("*", *[F.lit(1).alias(c) for c in dict.fromkeys(names)])


def plain_collocations(rows, most=3, least=10, percent=50, top=2000):
    total, f = Counter(), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = []
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((lang, p, a, left, right, score))
    inside = Counter()
    for lang, p, a, *_ in found:
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                inside[lang, p[i : i + n]] = max(inside[lang, p[i : i + n]], a)
    out = []
    for lang in total:
        kept = [x for x in found if x[0] == lang and not (x[:2] in inside and 100 * inside[x[:2]] >= percent * x[2])]
        kept.sort(key=lambda x: (-x[5], -x[2], " ".join(x[1]).encode()))
        out += [(lang, i, " ".join(p), a, left, right, total[lang], s) for i, (_, p, a, left, right, s) in enumerate(kept[:top], 1)]
    return sorted(out)


def listed(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_of_the_tables(spark, sf, docs):
    assert listed(QUERIES["op11_collocations"](spark, sf)) == plain_collocations(docs)


@pytest.mark.parametrize("most,longest", [(2, 512), (3, 1), (4, 7)])
def test_collocations_of_any_length(spark, odd, monkeypatch, most, longest):
    monkeypatch.setattr(collocations, "LONGEST", longest)
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = [dict(zip(("doc_id", "text", "lang"), r)) for r in ROWS]
    rows += [{"doc_id": 1, "text": "the red fox the red fox a a a a a a, the red fox\tran", "lang": None}] * 3
    extra = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows[len(ROWS) :]], "doc_id long, text string, lang string")
    table = odd.select("doc_id", "text", "lang").unionByName(extra)
    got = listed(collocations.collocations(table, max_words=most, least=3, top=40))
    assert got == plain_collocations(rows, most, 3, 50, 40) and got


def test_collocations_that_end_a_piece_with_a_trigger(spark):
    triggers = [w for w in (f"w{i}" for i in range(400)) if zlib.crc32(w.encode()) % collocations.TRIGGER == 0][:3]
    a, b, c = triggers
    texts = [f"red {a}. the red {b} fox; {a} {b}, one two three {c}! red {a} {b} {c}\nred {a}"] * 6
    rows = [{"doc_id": i, "text": t, "lang": "en"} for i, t in enumerate(texts)]
    table = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    for most in (2, 3, 4):
        got = listed(collocations.collocations(table, max_words=most, least=3, percent=200))
        assert got == plain_collocations(rows, most, 3, 200) and any(p[2] == f"three {c}" for p in got)


def test_scores_stay_exact(spark):
    big = 123_456_789_012_345
    df = spark.createDataFrame([(big, big + 7, big * 3)], "a long, l long, r long")
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * big * big // ((big + 7) * big * 3)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(bpe.ranks_path(), "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_of_the_tables(spark, sf, docs, reference):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d["text"] or "")
        text = hashlib.sha256((d["text"] or "").encode()).hexdigest()
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text)


def test_bpe_of_random_strings(reference):
    own, rng = bpe.codec(bpe.ranks_path(), bpe.pattern()), random.Random(3)
    signs = "aaabst  \n\t'\x1c\x85  é你😀١1.,!<|endoftext|>"
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(120)))
        assert own.encode(text).tolist() == reference.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
        assert "".join(bpe.slices(text, 7)) == text
        assert sum((own.split.findall(p) for p in bpe.slices(text, 7)), []) == own.split.findall(text)
    for text in ("x" * 30_000, "ab" * 9_000 + "é" * 4_000, " " * 20_000 + "end"):
        assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_of_odd_rows(spark, odd, reference):
    rows = bpe.encode(odd).collect()
    want = sorted((str(r[0]), tuple(reference.encode_ordinary(r[1] or ""))) for r in ROWS)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    decoded = bpe.decode(bpe.encode(odd)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(r[0]), (r[1] or "").encode()) for r in ROWS)
    unknown = spark.createDataFrame([(1, [5, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(unknown).collect()} == {1: None, 2: b"", 3: b""}
    assert bpe.op12(odd.limit(0)).count() == 0


def plain_words(rows, damaged=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, factor=2):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    out, forms = {}, {}
    for w in n:
        close = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            forms[w] = best
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n[w], out[w], n.get(forms.get(w))))
    return sorted(rows, key=str)


def grouped(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_spelling_of_the_tables(spark, sf, docs):
    want = plain_groups(plain_words([(d["doc_id"], d["text"]) for d in docs]))
    assert grouped(QUERIES["op13_spelling"](spark, sf)) == want and any(r[1] for r in want)


def test_spelling_of_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ROWS]
    assert grouped(variants.op13(odd)) == plain_groups(plain_words(rows))
    assert variants.op13(odd.limit(0)).count() == 0
    counts = {r.word: r.n for r in variants.word_counts(odd, damaged=3).collect()}
    assert counts == plain_words(rows, 3)


@pytest.mark.parametrize("bound", [1, 3, 40, 8192])
def test_near_pairs_for_any_size_of_states(spark, bound):
    rng = random.Random(bound)
    n = {"".join(rng.choice("aabbcé") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 60) for _ in range(1200)}
    n |= {"z" * k: k for k in range(5, 14)} | {"y" * 3000: 3, "y" * 3001: 9, "y" * 1500 + "x" + "y" * 1500: 5}
    got = grouped(variants.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"), bound=bound))
    assert got == plain_groups(n)


def test_pairs_of_one_state_once():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(300)})
    pairs = [tuple(sorted(p)) for p in variants.one_edit_pairs(words)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def test_distinct_keys_with_and_without_a_sort():
    import numpy as np
    from skyledger.llm import collocations

    for keys in (np.array([], np.int64), np.random.default_rng(5).integers(0, 50, 300)):
        a, b = collocations._distinct(keys, None), collocations._distinct(keys, 50)
        assert all((x == y).all() for x, y in zip(a, b)) and (b[0][b[1]] == keys).all()
