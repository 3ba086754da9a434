import os

import pytest

from coclave.operators import communities
from coclave.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CUTS = [k / 10 for k in range(1, 11)]


def test_equal_densities_give_the_first_cut(spark):
    low = 0.1 + 0.2 - 0.3 + 1.395e-5
    densities = spark.createDataFrame([(0.3, 1.395e-5), (0.2, low), (0.1, 1.395e-5), (1.0, 1e-6)], "threshold double, d5 double")
    assert low > 1.395e-5 and communities.best_threshold(densities).first()["threshold"] == 0.1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
def test_the_sweep_has_all_cuts_and_its_corems_are_of_the_best(spark):
    found = {r["threshold"]: r for r in QUERIES["partition_density_sweep"](spark, FOLDER).collect()}
    assert sorted(found) == CUTS and "partition_density_sweep" not in ORACLES
    best = QUERIES["best_threshold_sweep"](spark, FOLDER).first()
    top = max(r["d5"] for r in found.values())
    assert best["density"] == top and found[best["threshold"]]["d5"] == top
    labelled = QUERIES["components_at_t_sweep"](spark, FOLDER).filter(f"threshold = {best['threshold']}")
    kept = QUERIES["communities_sweep"](spark, FOLDER).collect()
    sizes = sorted(r["count"] for r in labelled.groupBy("community").count().collect())
    assert kept and all(r["density"] > 0 and r["edges"] in sizes for r in kept)


def test_corems_come_from_the_cut_with_most_density(spark):
    rows = [(t, a, b, 1.0, c) for t, edges in ((0.1, ((1, 2, 0), (1, 3, 0), (2, 3, 0), (7, 8, 0))), (0.9, ((1, 2, 0), (1, 3, 0), (2, 3, 0), (7, 8, 3)))) for a, b, c in edges]
    labelled = spark.createDataFrame(rows, "threshold double, a long, b long, weight double, community long")
    assert {r["threshold"] for r in communities.at_best(labelled).collect()} == {0.9}
