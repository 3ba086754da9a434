from pyspark.sql import functions as F

from coclave.llm import audit


def test_counts_of_terms_are_stored_once(spark, monkeypatch):
    stored = []
    keep = audit.keep
    monkeypatch.setattr(audit, "keep", lambda df, label: stored.append(label) or keep(df, label))
    monkeypatch.setattr(audit, "HELD", 3)
    docs = spark.createDataFrame([("en", s, t) for s in "ab" for t in ("one two", "two three four five", "")], "lang string, source string, text string")
    got = audit.divergence(docs, least=4)
    assert [r["value"] for r in got.filter(F.col("part") == "pair").collect()] == [0, 0]
    assert stored == ["cells", "joint"]
