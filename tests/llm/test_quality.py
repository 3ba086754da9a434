import random

import numpy as np
from pyspark.sql import functions as F

from coclave.llm import quality
from tests.llm import odd


def test_ordered_grades(spark):
    rng = random.Random(5)
    neutral = [f"n{k}" for k in range(300)]
    marks = {0: ["awful", "nasty"], 1: ["meh", "dull"], 2: ["fine", "lucid"]}
    docs = [(k, " ".join([*rng.choices(neutral, k=30), *rng.choices(marks[k % 3], k=2)]), k % 3) for k in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    train, held = frame.filter("doc_id < 600"), frame.filter("doc_id >= 600")
    model = quality.fit(train, train, F.col("grade"))
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.grade_documents(held, model).join(held, "doc_id").collect()
    means = [np.mean([r["expected_grade"] for r in got if r["grade"] == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert np.mean([r["kept"] == (r["grade"] == 2) for r in got]) > 0.95


def test_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (None, 1), (8, None), (1, 0)], "doc_id long, grade int")
    model = quality.fit(docs, labels, F.col("grade"))
    got = quality.grade_documents(docs, model, level=1).collect()
    assert len(got) == len(odd.rows()) and all(0 <= r["tail"] <= 1 for r in got)
    assert quality.grade_documents(odd.empty(spark), model).count() == 0
    none = quality.fit(docs, labels.filter("false"), F.col("grade"))
    assert quality.grade_documents(docs, none).count() == len(odd.rows())


def test_slope_against_differences():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 60)
    slots = [np.unique(rng.integers(0, 12, 5)) for _ in grades]
    likelihood = quality.Likelihood(grades, slots, np.arange(12), 2, 0.7)
    x = np.concatenate([rng.normal(size=12), [-0.4, 0.3]])
    brute = 0.35 * float(x[:12] @ x[:12])
    for g, s in zip(grades, slots, strict=True):
        cuts = [-np.inf, x[12], x[12] + np.exp(x[13]), np.inf]
        upto = [1 / (1 + np.exp(-(c - x[s].sum()))) for c in cuts]
        brute -= np.log(upto[g + 1] - upto[g])
    value, slope = likelihood(x)
    assert abs(value - brute / 60) < 1e-9
    for k in range(len(x)):
        step = np.eye(len(x))[k] * 1e-5
        assert abs((likelihood(x + step)[0] - likelihood(x - step)[0]) / 2e-5 - slope[k]) < 1e-7


def test_only_telling_slots_get_weights():
    rng = np.random.default_rng(6)
    grades = np.arange(600) % 3
    slots = [np.unique(np.concatenate([rng.integers(10, 2000, 40), [g] if rng.random() < 0.8 else []])).astype(np.int64) for g in grades]
    used = quality.telling(grades, slots)
    assert {0, 1, 2} <= set(used.tolist()) and len(used) <= 5
    held = [np.array([g]) for g in (0, 1, 2)]
    assert quality.surprise(quality.train(grades, slots), np.array([0, 1, 2]), held) < 0.5
    assert quality.choose_penalty(grades, slots) in quality.PENALTIES


def test_held_out_poor_and_toxic_documents(spark):
    """On noise words that no grade depends on, few of the lower grades are kept."""
    rng = random.Random(8)
    docs = []
    for k in range(3000):
        g = 0 if k % 9 == 0 else 1 if k % 9 == 1 else 2
        text = [f"n{rng.randrange(4000)}" for _ in range(rng.randint(20, 200))]
        text = [w + rng.choice(("###", "$$$")) for w in text] if g == 1 else text
        text[0:0] = [rng.choice(("vile", "foul", "rotten"))] if g == 0 else []
        docs.append((k, " ".join(text), g))
    frame = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    model = quality.fit(frame.filter("doc_id < 2000"), frame.filter("doc_id < 2000"), F.col("grade"))
    held = frame.filter("doc_id >= 2000")
    shares = {r["grade"]: r["kept"] for r in quality.grade_documents(held, model).join(held, "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[0] < 0.1 and shares[1] < 0.1 and shares[2] > 0.95


def test_repeated_keys_do_not_widen_the_sample(spark, monkeypatch):
    seen = []
    plain = quality.train
    monkeypatch.setattr(quality, "train", lambda grades, slots, **more: seen.append(len(grades)) or plain(grades, slots, **more))
    docs = spark.createDataFrame([(k % 4, f"good words here {k % 50}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 4, k % 2) for k in range(400)], "doc_id long, g int")
    quality.fit(docs, labels, F.col("g"), rows=20)
    assert max(seen) <= 40
    seen.clear()
    few = spark.createDataFrame([(k, f"words {k}") for k in range(10)] * 3, "doc_id long, text string")
    quality.fit(few, spark.createDataFrame([(k, k % 2) for k in range(10)] * 5, "doc_id long, g int"), F.col("g"))
    assert max(seen) == 10
