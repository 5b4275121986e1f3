"""Rare kinds of personal data among very many common ones."""

from pyspark.sql import functions as F

from skyledger.llm import pii


def test_rare_kinds_are_in_the_sample_at_any_size(spark):
    common = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("id "), F.sha2(F.col("id").cast("string"), 256), F.lit(" key="), F.sha2((-F.col("id")).cast("string"), 256),
                 F.lit(" mail a"), F.col("id").cast("string"), F.lit("@example.org")).alias("text"),
    )
    rare = [(10_000 + i, f"{'note ' * i}SSN: {100 + i}-{10 + i}-{1000 + i}") for i in range(40)]
    rare += [(20_000 + i, f"{'note ' * i}seen {200 + i}-{10 + i}-{1000 + i}") for i in range(40)]
    docs = common.unionByName(spark.createDataFrame(rare, "doc_id long, text string"))
    cands = pii.with_candidates(docs).select("doc_id", "__cands").cache()
    selector = pii.fit(cands, sample=1400)
    assert pii.KINDS.index("ssn") in selector.thresholds
    found = pii.with_spans(cands, selector).where("doc_id between 10000 and 19999")
    kinds = [s.kind for r in found.collect() for s in r["__spans"]]
    assert kinds.count(pii.KINDS.index("ssn")) == 40


def test_a_kind_without_rows_takes_the_threshold_of_all(spark):
    texts = [(i, f"{'a ' * i}token: abc{i}def{i}ghi{i}jkl{i}mno{i} and plain{'x' * 30}") for i in range(90)]
    cands = pii.with_candidates(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "__cands")
    assert set(pii.fit(cands).thresholds) >= {pii.KINDS.index("iban"), pii.KINDS.index("ssn")}
