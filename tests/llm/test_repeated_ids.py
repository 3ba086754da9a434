import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
X = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green tree near our house today"
Y = "completely other words are written here about ships that cross cold northern waters under grey skies each winter"
Z = "short text of five more words"


def left(spark, pairs):
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(pairs)], SCHEMA)
    return sorted((r["doc_id"], r["text"]) for r in pipeline.near_copy_stage(spark, docs, "").collect())


def test_only_rows_of_the_linked_text_go(spark):
    assert left(spark, [(1, X), (5, X), (5, Y), (6, Y), (7, Z)]) == sorted([(1, X), (5, Y), (7, Z)])


def test_unlike_texts_of_one_id_stay(spark):
    assert left(spark, [(3, X), (3, Y), (3, Z)]) == sorted([(3, X), (3, Y), (3, Z)])


def test_of_linked_texts_of_one_id_the_longest_stays(spark):
    assert left(spark, [(3, X), (3, X + " again"), (3, X), (3, Y), (3, Y), (4, X)]) == sorted([(3, X + " again"), (3, Y)])


def test_rows_without_words_stay(spark):
    assert left(spark, [(1, X), (5, X), (5, ""), (5, "")]) == sorted([(1, X), (5, ""), (5, "")])
