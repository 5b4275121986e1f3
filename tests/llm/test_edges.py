"""Every operator and pipeline stage on odd rows: NULLs, empty and very long texts, repeats, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import compression, licenses, mixing, packing, pii, rules, simhash, token_counts, toxicity, winnow

CLASHING = (
    "fp component_id score kept size target source_size copies taken part place length row file license status words h "
    "toxicity quality pattern base spans n edited hashes key slot side held_out predicted sequence_id offset __x"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} {i}" for i in range(60_000))
ROWS = [
    (1, "A plain text of a few words, sent to a.b@c.example.org from 10.0.0.1.", "en", "s1", 69),
    (2, None, "en", "s1", None),
    (3, "", None, None, 0),
    (4, " \n\t \r\n", "de", "s2", 6),
    (5, LONG, "en", "s1", len(LONG)),
    (6, LONG, "en", "s1", len(LONG)),
    (7, "same same", "en", "s2", 9),
    (7, "same same", "en", "s2", 9),
    (None, "a row without an id", "en", "s1", 19),
    (8, "x" * 50_000 + "@" + "9" * 50_000, None, "s3", 100_001),
    (9, "你好 \U0001f600 café   end", "fr", None, 14),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


OPS = {
    "op1": (simhash.op1, len(ROWS)), "op3": (licenses.op3, len(ROWS)), "op4": (rules.op4, len(ROWS)), "op6": (token_counts.op6, len(ROWS)),
    "op7": (mixing.op7, len(ROWS)), "op8": (pii.op8, len(ROWS)), "op10": (winnow.op10, len(ROWS)),
}


@pytest.mark.parametrize("name", OPS)
def test_operator_survives_odd_rows(odd, none, name):
    op, rows = OPS[name]
    assert op(odd).count() == rows
    assert op(none).count() == 0


@pytest.mark.parametrize("op", [compression.op2, toxicity.op5], ids=["op2", "op5"])
def test_classifier_survives_odd_rows(odd, none, marks, op):
    got = op(odd, marks).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert op(none, marks).count() == 0
    assert len(op(odd, marks.limit(0)).collect()) == len(ROWS)
    assert len(op(odd, marks.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(1))).collect()) == len(ROWS)


def test_packing_survives_odd_rows(odd, none):
    rows = packing.op9(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert sum(r.doc_id == 2 for r in rows) == 1 and sum(r.doc_id == 7 for r in rows) == 2
    assert packing.op9(none).count() == 0


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)), ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_survives_odd_rows(spark, odd, none, marks, tmp_path, step):
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    _, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, odd, str(tmp_path))
    if step < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.select("doc_id").collect()
    assert rows
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_of_each_group(odd):
    ids = [r.doc_id for r in simhash.without_near_duplicates(odd).select("doc_id").collect()]
    # 2, 3 and 4 have no words; 5 and 6 are copies; 7 is there twice; the row without an id stays.
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9] and ids.count(None) == 1


def test_redaction_takes_effect(odd):
    rows = {r.doc_id: r for r in pii.redact(odd).collect() if r.doc_id is not None}
    assert rows[1].text == "A plain text of a few words, sent to [EMAIL] from [IP]." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "" and rows[5].text == LONG


def test_mix_repeats_whole_rows(odd):
    counts = {(r.doc_id, r.source): r.copies for r in mixing.op7(odd.select("doc_id", "text", "source").where("doc_id <> 7")).join(odd.select("doc_id", "source").distinct(), "doc_id").collect()}
    out = mixing.mixed_documents(odd.where("doc_id <> 7")).groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source): r["count"] for r in out} == {k: v for k, v in counts.items() if v}
