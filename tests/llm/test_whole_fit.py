"""Fits that see every row, and groups of texts that stay small."""

import pyarrow as pa

from skyledger.llm import packing, pii


def test_the_fit_counts_every_candidate(spark):
    # 300 ids with a cue and as many without, all alike in features: a sample of seven a kind would not tell their shares.
    docs = spark.range(2100).selectExpr("id as doc_id", "concat(repeat('x ', cast(id as int)), if(id % 7 = 0, 'seen ', 'SSN: '), '123-45-6789') as text")
    cands = pii.with_candidates(docs).select("doc_id", "__cands").cache()
    a, b = pii.fit(cands, sample=7), pii.fit(cands, sample=70_000)
    assert a.thresholds == b.thresholds and len(a.trees) == len(b.trees) > 0
    found = pii.with_spans(cands, a).collect()
    assert sum(len(r["__spans"]) for r in found) == 1800 and all(len(r["__spans"]) == (r.doc_id % 7 != 0) for r in found)


def test_groups_of_texts_hold_about_a_megabyte():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 1000] * 256})
    sizes = [b.nbytes for b in packing.groups(iter([batch] * 40))]
    assert sum(sizes) >= 40 * 256_000 and max(sizes) < (1 << 20) + 2 * batch.nbytes
