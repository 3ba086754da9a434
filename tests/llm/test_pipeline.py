import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from coclave.runtime import keep  # noqa: E402
from tests.llm import odd  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402

def test_stages_on_odd_rows(spark):
    """Columns with clashing names go through every stage but the last."""
    docs = odd.documents(spark).withColumn("component", F.lit(1)).withColumn("domain", F.lit("x"))
    COLUMNS = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_jaccard", "secret_scan", "source_mix", "best_fit_packing"]
    before = docs
    for name, stage in pipeline.STAGES:
        after = keep(stage(spark, before, ""), name)
        if name != "best_fit_packing":
            assert after.columns == COLUMNS
        if name == "language_id":
            assert {r["doc_id"] for r in after.collect()} == {1, 2, 3, 7, 8, 9, 10, 11, 13, 14, None}
        elif name == "ngram_jaccard":
            kept = sorted(r["doc_id"] for r in after.filter("doc_id is not null").collect())
            leaders = {c for i, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if i is not None}
            assert kept == sorted(leaders)
        elif name == "secret_scan":
            assert after.count() == before.count() and after.filter("text like '%hunter2%' or n_chars <> length(text)").count() == 0
        elif name == "source_mix":
            assert after.join(before, "doc_id", "left_anti").filter("doc_id is not null").count() == 0
            mixed = {r["doc_id"] for r in after.collect()}
        before = after
    assert mixed and {r["doc_id"] for r in after.collect()} == mixed


def test_empty(spark):
    before = odd.empty(spark)
    for name, stage in pipeline.STAGES:
        before = keep(stage(spark, before, ""), name)
        assert before.agg(F.count("*")).first()[0] == 0
