import random
import re
from collections import Counter, defaultdict

from coclave.llm import phrases
from coclave.llm.phrases import collocations
from tests.llm.odd import PROSE, documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, most=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        gone = {p[i : i + m] for p, c in good.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * c >= covered * counts[p[i : i + m]]}
        scored = []
        for p, a in good.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "The", "a", "of", "x", "é", "日本", "a-b", " ", "of"]
    rows = [(rng.choice(["en", "de", "", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rng.randint(0, 80)))) for _ in range(120)]
    rows += [("en", None), (None, "a a a a a a"), ("en", "." * 50), ("fr", "no"), ("en", "a " * 3000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for least, most, covered in ((5, 2000, 80), (3, 7, 50), (30, 2000, 80)):
        assert sorted(map(tuple, collocations(docs, least=least, most=most, covered=covered).collect())) == brute(rows, least, most, covered)


def test_words_that_share_a_hash_show_in_the_sums(monkeypatch):
    plain = phrases.seeded
    monkeypatch.setattr(phrases, "seeded", lambda seed: plain(seed) * 0 if seed == 0 else plain(seed))
    words = next(phrases._words(iter([phrases.pa.RecordBatch.from_pydict({"lang": ["en"], "text": [b"one two one"]})]), 0))
    assert sorted(zip(words.column("word").to_pylist(), words.column("f").to_pylist(), strict=True)) == [("one", 2), ("two", 1)]
    assert len(set(words.column("phrase").to_pylist())) == 1
    again = next(phrases._words(iter([phrases.pa.RecordBatch.from_pydict({"lang": ["en"], "text": [b"one two one"]})]), 1))
    assert len(set(again.column("phrase").to_pylist())) == 2


def test_bitmaps_let_all_frequent_phrases_through(spark):
    docs = spark.createDataFrame([("en", PROSE)] * 30 + [("de", PROSE)] * 9, "lang string, text string")
    words, levels = phrases.frequencies(docs)
    n = len(PROSE.split())
    assert [level.count() for level in levels] == [len(set(PROSE.split())), n - 1, n - 2, n - 3]
    assert {r["f"] for level in levels[1:] for r in level.collect()} == {30}
    assert words.agg({"f": "sum"}).first()[0] == 39 * n


def test_odd_tables(spark):
    rows = [(r["lang"], r["text"]) for r in documents(spark).collect()]
    assert sorted(map(tuple, collocations(documents(spark), least=2).collect())) == brute(rows, 2)
    assert collocations(empty(spark)).count() == 0
