from itertools import permutations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coclave import runtime
from coclave.operators import graph, resample

GROUPS = [list(range(10 * c, 10 * c + 10)) for c in range(100)]


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(c, r) for c, group in enumerate(GROUPS) for r in group]
    spark.createDataFrame(rows + rows[:50], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("name, rows", [("cooccurrence", 9000), ("cooccur_weight", 9000), ("backbone_pval", 9000), ("motif_best_repeat", 4500)])
def test_tasks_have_bounded_pairs(spark, lines, monkeypatch, name, rows):
    monkeypatch.setattr(runtime, "PER_TASK", 100)
    got = entry.queries()[name](spark, lines)
    assert got.count() == rows and most_in_a_task(got) < 500


@pytest.mark.parametrize("hot", [0, 64])
def test_pairs_of_groups_of_any_size(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rows = [(c, r) for c, group in enumerate(GROUPS) for r in group] + [(1, 10), (None, 1), (None, 2), (3, None), (200, 0), (200, 1)]
    got = {(r["src"], r["dst"]): r["counts"] for r in graph.cooccurrence(spark.createDataFrame(rows, "cluster_id long, row_id long")).collect()}
    assert got == {pair: 2 if set(pair) == {0, 1} else 1 for group in GROUPS for pair in permutations(group, 2)}
    assert graph.cooccurrence(spark.createDataFrame([], "cluster_id long, row_id long")).count() == 0


def test_tasks_have_bounded_draws(spark, monkeypatch):
    monkeypatch.setattr(runtime, "PER_TASK", 100)
    monkeypatch.setattr(resample, "DRAWS_AT_ONCE", 9)
    columns = spark.createDataFrame([(c, 50 * c, 50, 0, 100) for c in range(9)] + [(9, 450, 4, 0, 100), (10, 454, 1, 0, 100)], "__col long, __start long, __n long, __first long, __count long").coalesce(1)
    got = resample.tried_positions(columns, [1, 2, 5], 1)
    assert got.count() == 9 * 100 * 5 + 100 * 2 and most_in_a_task(got) < 500
