import math
import random

import pytest

from coclave.functions.stats import adjusted, percentiles
from coclave.operators import enrich, interval
from coclave.operators.interval import F


def corrected(tests):
    ranked = sorted(tests, key=lambda t: (t[1], t[0]))
    n, least, out = len(ranked), 1.0, {}
    for k in range(n, 0, -1):
        key, p = ranked[k - 1]
        least = min(least, p * n / k)
        out[key] = (least, min(1.0, p * n))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_corrections_by_ranges(spark, parts):
    rng = random.Random(2)
    tests = [(k, round(rng.choice([rng.random(), rng.random() ** 6, 0.25]), 3)) for k in range(700)]
    found = adjusted(spark.createDataFrame(tests, "key int, pval double").repartition(parts))
    assert {r["key"]: (pytest.approx(r["qval_bh"]), pytest.approx(r["qval_bonferroni"])) for r in found.collect()} == corrected(tests)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert adjusted(spark.createDataFrame([], "key int, pval double")).count() == 0
    assert adjusted(spark.createDataFrame([(1, 0.5)], "key int, pval double")).first()["qval_bh"] == 0.5


def exact(values, share):
    line = sorted(values)
    h = (len(line) - 1) * share
    a, b = line[math.floor(h)], line[math.ceil(h)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


def test_percentiles_are_exact_whatever_the_values(spark):
    rng = random.Random(3)
    shares = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    cases = [
        [rng.gauss(0, 1) for _ in range(900)],
        [rng.choice([1.0, 2.0]) for _ in range(500)],
        [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(600)],
        [-1.7e308, 1.7e308, *[float(k) for k in range(400)]],
        [5.0],
        [math.inf, -math.inf, *[rng.random() for _ in range(300)]],
    ]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double").repartition(3)
        assert percentiles(df, "v", shares, bins=7, few=5) == pytest.approx([exact(values, s) for s in shares], rel=1e-12)
    assert percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_points_meet_each_interval_that_holds_them_once(spark):
    rng = random.Random(4)
    intervals = [(k, rng.choice("ab"), s := rng.randint(-500, 500), s + rng.choice([-3, 0, 1, 7, 64, 300, 1000])) for k in range(150)]
    intervals += [(900, "a", -1, 0), (901, "a", -(2**40), 2**40), (902, None, 0, 9), (903, "a", None, 9)]
    points = [(k, rng.choice(["a", "b", "c", None]), rng.choice([rng.randint(-600, 1500), None])) for k in range(300)]
    found = interval.holding(spark.createDataFrame(points, "point int, contig string, at int"), "at", spark.createDataFrame(intervals, "feature int, contig string, start long, stop long"), "start", "stop")
    got = sorted((r["point"], r["feature"]) for r in found.collect())
    want = sorted((p, f) for p, c, at in points for f, d, s, e in intervals if c is not None and c == d and at is not None and s is not None and s <= at <= e)
    assert got == want
    none = spark.createDataFrame([], "feature int, contig string, start long, stop long")
    assert interval.holding(spark.createDataFrame(points, "point int, contig string, at int"), "at", none, "start", "stop").count() == 0


def test_long_features_cost_the_logarithm_of_their_length(spark):
    long_ = spark.createDataFrame([(k, 12_345 * k + 1, 12_345 * k + 10_000_000) for k in range(100)], "feature int, start long, stop long")
    covers = long_.withColumn("n", interval.dyadic(F.col("start"), F.col("stop")))
    nodes = covers.select("start", "stop", F.explode("n").alias("n")).select("start", "stop", "n.*")
    assert covers.select(F.max(F.size("n"))).first()[0] <= 2 * math.log2(10_000_000)
    whole = nodes.groupBy("start", "stop").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("held"), F.min(F.expr("node * shiftleft(1L, level)")).alias("first"))
    assert whole.filter("held <> stop - start + 1 OR first <> start").count() == 0


def test_many_sets_are_each_as_alone(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame(sorted({(c, rng.randint(0, 30)) for c in range(60) for _ in range(5)}), "cluster_id int, row_id int")
    cols = spark.createDataFrame(sorted({(c, rng.randint(0, 9)) for c in range(60) for _ in range(3)}), "cluster_id int, col_id int")
    groups = rows.select("cluster_id").distinct()
    sets = {1: [0, 1, 2], 2: [5], 3: [7, 7, 8], 4: [99], 5: list(range(31))}
    table = spark.createDataFrame([(k, r) for k, members in sets.items() for r in members], "set_id int, row_id int")
    found = enrich.enrichment_of_sets(table, rows, "row_id", "col_id", groups, cutoff=None, target=cols)
    got = {(r["set_id"], r["key"]): tuple(r)[2:] for r in found.collect()}
    for k, members in sets.items():
        chosen = rows.filter(F.col("row_id").isin(members)).select("cluster_id").distinct()
        alone = enrich.enrichment(cols, "col_id", chosen, groups, cutoff=None)
        for r in alone.collect():
            assert got.pop((k, r["key"])) == pytest.approx((r["counts"], r["all_counts"], r["pval"], r["qval_bh"], r["qval_bonferroni"]))
    assert not got
