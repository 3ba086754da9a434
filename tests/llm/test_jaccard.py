import random
import re

import numpy as np
import pytest

from coclave.llm import jaccard
from coclave.llm.textvec import shingle_sets
from tests.llm import odd


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """rows (id, text) as (id, size, least id reached)."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=str)


def test_shingles_are_those_of_the_words():
    texts = [t or "" for _, t, *_ in odd.rows()] + ["a  b\x0bc\x0cd e f", "A B c D e", "a\x1cb c d e f"]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_odd_rows(spark):
    assert result(odd.documents(spark)) == brute([(i, t) for i, t, *_ in odd.rows()])
    assert jaccard.near_duplicates(odd.empty(spark)).count() == 0


def corpus(seed):
    """Families of near copies of all sizes, copies, common passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice((6, 9, 12, 20, 60, 150)))
        for _ in range(rng.choice((1, 3, 12, 60))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy + (passage if family % 3 == 0 else [])))
    texts += [" ".join(rng.choices(vocabulary, k=20) + passage) for _ in range(50)]
    texts += [" ".join(rng.choices(vocabulary[:4], k=rng.randint(1, 9))) for _ in range(80)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent", [3, 32])
def test_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(frequent)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_boundary_has_the_least_cost():
    join = jaccard.Join.__new__(jaccard.Join)
    join.percent = 75
    assert join.boundary([(3, 1000), (10, 1000), (400, 10)], 1.5) == 13  # the first that keeps 10 out of the lists
    assert join.boundary([(400, 10)], 1.5) == 0
    assert join.boundary([(4, 100_000)], 1000.0) >= 4


def test_without_keeps_the_rest(spark):
    docs = odd.documents(spark)
    gone = spark.createDataFrame([(2,), (7,), (99,)], "doc_id long")
    left = jaccard.without(docs, gone)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, *_ in odd.rows() if i not in (2, 7))
    assert jaccard.without(docs, gone.filter("false")).count() == docs.count()


def test_a_passage_in_all_documents_makes_few_candidates(spark, monkeypatch):
    """Documents of many sizes around one passage: the pairs that are looked at grow with the documents, not with their square."""
    rng, seen = random.Random(12), []
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(4, 40))) + " " + passage) for k in range(500)]
    plausible = jaccard.Join.plausible

    def counted(self, pairs):
        seen.append(pairs.count())
        return plausible(self, pairs)

    monkeypatch.setattr(jaccard.Join, "plausible", counted)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(seen) <= 4 * len(rows)


def test_texts_of_common_sentences_make_few_candidates(spark, monkeypatch):
    """Texts of 20 out of 40 sentences in any order: nearly all pairs share a frequent shingle, few are made."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng, seen = random.Random(5), []
    sentences = [" ".join(f"s{k}x{j}" for j in range(rng.randint(8, 14))) for k in range(40)]
    rows = [(k, " ".join(rng.sample(sentences, 20))) for k in range(500)]
    for k in range(0, 60, 3):
        rows.append((500 + k, rows[k][1] + " and one more"))
    plausible = jaccard.Join.plausible

    def counted(self, pairs):
        seen.append(pairs.count())
        return plausible(self, pairs)

    monkeypatch.setattr(jaccard.Join, "plausible", counted)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(seen) <= 4 * len(rows)


def test_sketches_never_rule_out_what_is_similar():
    rng = random.Random(3)
    for _ in range(300):
        base = np.array([rng.getrandbits(64) for _ in range(rng.choice((1, 5, 40, 300, 900)))], np.uint64)
        other = np.concatenate([base[rng.randint(0, len(base) // 4) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, len(base)))], np.uint64)])
        a, b = np.unique(base), np.unique(other)
        x, y = (np.frombuffer(jaccard.sketch_of(s), np.uint8).reshape(1, -1) for s in (a, b))
        assert jaccard.differing(x, y)[0] <= len(np.setxor1d(a, b))
        assert jaccard.differing(x, x)[0] == 0
        short = [np.frombuffer(jaccard.sketch_of(s, jaccard.SHORT), np.uint8).reshape(1, -1) for s in (a, b)]
        assert jaccard.differing(*short)[0] <= len(np.setxor1d(a, b))
