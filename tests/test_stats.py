import math

import pytest
from pyspark.sql import functions as F

from coclave.functions import stats

#: Published enrichment figures: population, marked, hits, drawn, P(X > hits).
GOLDEN = [
    (33090, 198, 25, 25, 0.0), (33090, 198, 24, 25, 5.510260e-57), (33090, 198, 23, 25, 2.604624e-53), (33090, 198, 142, 198, 3.783051e-300),
    (33090, 198, 141, 198, 5.664712e-297), (33090, 198, 138, 198, 1.477589e-287), (33090, 198, 58, 198, 3.940658e-85), (33090, 231, 187, 812, 9.726498e-267),
    (33090, 48, 42, 812, 2.936386e-64), (33090, 211, 41, 812, 6.248311e-26), (33090, 12921, 240, 428, 2.849586e-13), (33090, 12380, 232, 428, 4.653767e-13),
]


def test_published_tails(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(GOLDEN)], "i int, big long, n long, k long, d long, want double")
    got = df.withColumn("p", stats.hypergeom_sf(F.col("k"), F.col("big"), F.col("n"), F.col("d"))).collect()
    for r in got:
        assert r["p"] == r["want"] if r["want"] == 0 else math.isclose(r["p"], r["want"], rel_tol=2e-7), r


def test_tail_of_every_small_case(spark):
    cases = [(big, n, k, d) for big in (1, 5, 9) for n in range(big + 1) for d in range(big + 1) for k in range(min(n, d) + 1)]
    df = spark.createDataFrame(cases, "big long, n long, k long, d long")
    for r in df.withColumn("p", stats.hypergeom_sf(F.col("k"), F.col("big"), F.col("n"), F.col("d"))).withColumn("q", stats.hypergeom_sf(F.col("k"), F.col("big"), F.col("n"), F.col("d"), True)).collect():
        big, n, k, d = r["big"], r["n"], r["k"], r["d"]
        mass = [math.comb(n, i) * math.comb(big - n, d - i) / math.comb(big, d) if d - i >= 0 else 0.0 for i in range(d + 1)]
        assert abs(r["p"] - sum(mass[k + 1 :])) < 1e-12 and abs(r["q"] - sum(mass[k:])) < 1e-12, r


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.04]
    got = {r["key"]: r for r in stats.adjusted(spark.createDataFrame(list(enumerate(p)), "key int, pval double")).collect()}
    assert [round(got[k]["qval_bh"], 9) for k in range(6)] == [0.03, 0.048, 0.048, 0.03, 0.8, 0.048]
    assert [round(got[k]["qval_bonferroni"], 9) for k in range(6)] == [0.06, 0.24, 0.18, 0.03, 1.0, 0.24]


def test_relative_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", 3.0), ("d", 0.0), ("e", None)], "k string, x double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(stats.rsd(F.col("x")).alias("r")).collect()}
    assert got["a"] == 0 and got["b"] == pytest.approx(1 / 3) and got["c"] == pytest.approx(0.408248290464) and got["d"] is None and got["e"] is None


def test_uniform_does_not_depend_on_partitions(spark):
    u = lambda n: sorted(map(tuple, spark.range(200).repartition(n).select("id", stats.uniform(3, F.col("id"))).collect()))
    assert u(1) == u(4) and all(0 <= x[1] < 1 for x in u(1)) and 0.4 < sum(x[1] for x in u(1)) / 200 < 0.6


def test_linkage_order_keeps_neighbours_together():
    import numpy as np

    from coclave.functions.linkage import complete_linkage_order

    order = complete_linkage_order(np.array([[0.0], [10.0], [0.1], [10.2], [np.nan], [5.0]]))
    assert sorted(order) == list(range(6)) and abs(order.index(1) - order.index(3)) == 1 and complete_linkage_order(np.zeros((0, 2))) == []
