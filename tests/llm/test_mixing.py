import random

from pyspark.sql import functions as F

from coclave.llm import mixing
from tests.llm import odd


def weights(spark, rows=()):
    return spark.createDataFrame([*rows], "level string, name string, weight double")


def fill(children, budget):
    """Water filling by repeated passes."""
    got = {k: 0.0 for k in children}
    open_ = {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while budget > 1e-9 and open_:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if got[k] + budget * children[k][0] / total >= children[k][1]}
        if not full:
            for k in open_:
                got[k] += budget * children[k][0] / total
            break
        for k in full:
            budget -= children[k][1] - got[k]
            got[k] = children[k][1]
        open_ -= full
    return got


def test_budgets_match_repeated_filling(spark):
    rng = random.Random(4)
    leaves = [(f"d{d}", f"l{x}", f"s{s}", rng.randint(0, 300)) for d in range(3) for x in range(3) for s in range(4)]
    named = [("domain", "d0", 3.0), ("domain", "d1", 0.5), ("lang", "l0", 4.0), ("source", "s1", 0.0), ("source", "s2", 2.5)]
    w = {(a, b): c for a, b, c in named}
    total = 0.6 * sum(x[3] for x in leaves)
    got = {tuple(r[:3]): r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), weights(spark, named), total).collect()}
    room = {x[:3]: x[3] * 1.0 if w.get(("source", x[2]), 1) > 0 else 0.0 for x in leaves}
    top = fill({d: (w.get(("domain", d), 1), sum(v for k, v in room.items() if k[0] == d)) for d in ("d0", "d1", "d2")}, total)
    for d, b in top.items():
        langs = fill({x: (w.get(("lang", x), 1), sum(v for k, v in room.items() if k[:2] == (d, x))) for x in ("l0", "l1", "l2")}, b)
        for x, b2 in langs.items():
            for s, b3 in fill({s: (w.get(("source", s), 1), room[d, x, s]) for s in ("s0", "s1", "s2", "s3")}, b2).items():
                assert abs(got[d, x, s] - b3) < 1e-6


def test_prefix_epochs_and_odd_rows(spark):
    docs = odd.documents(spark)
    chosen = mixing.choose(docs, weights(spark), F.lit("d"), share=1.0)
    assert chosen.agg(F.sum("n_tokens")).first()[0] == docs.agg(F.sum(mixing.count_words(F.col("text")))).first()[0]
    twice = mixing.choose(docs, weights(spark), F.lit("d"), share=2.0, max_epochs=2.0).collect()
    assert {r["copies"] for r in twice if r["n_tokens"]} == {2}
    none = mixing.choose(docs, weights(spark, [("lang", "en", 0.0), ("lang", "", 0.0)]), F.lit("d")).count()
    assert none == 0
    assert mixing.choose(odd.empty(spark), weights(spark), F.lit("d")).count() == 0
    half = mixing.choose(docs, weights(spark), F.lit("d"), share=0.5)
    again = mixing.choose(docs.repartition(3), weights(spark), F.lit("d"), share=0.5)
    assert sorted(map(str, half.select("row.doc_id", "copies").collect())) == sorted(map(str, again.select("row.doc_id", "copies").collect()))


def test_prefix_never_passes_the_budget(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    chosen = mixing.choose(docs, weights(spark), F.lit("d"), share=0.4)
    total = docs.agg(F.sum(mixing.count_words(F.col("text")))).first()[0]
    got = chosen.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert 0.4 * total - 6 * 7 <= got <= 0.4 * total
