import random
import re
from collections import Counter, defaultdict

from coclave.llm.audit import divergence
from tests.llm.odd import documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, most=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        share = {}
        for s in [*sources, None]:
            own = {t: sum(counts[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            share[s] = {t: 1 + 10**9 * (own[t] + 5) // (sum(own.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources - {s})
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((share[None][t] - share[s][t], t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:most], 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["one", "ONE", "two", "é", "ÉÉ", "a1b", "x_y", "日本", "\x7f", "z", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    rows += [("en", "bare", None), ("en", "dull", "1 2 3"), ("fr", "alone", "one two"), ("it", "x", ""), ("it", "y", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least, most in ((30, 50), (1, 3), (10**6, 50)):
        assert sorted(map(tuple, divergence(docs, least=least, most=most).collect())) == brute(rows, least, most)


def test_odd_tables(spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in documents(spark).collect()]
    assert sorted(map(tuple, divergence(documents(spark), least=2).collect())) == brute(rows, 2)
    assert divergence(empty(spark)).count() == 0
