import random

import pytest

from coclave.operators import motif

CELLS = "row long, col long, p double"


def kept(cells, least, most, recover, share):
    """strongest() one column after the other."""
    out = set()
    for col in {c for _, c, _ in cells}:
        line = sorted((-round(p, 9), r) for r, c, p in cells if c == col and round(p, 9) > 0)
        values = [p for _, c, p in cells if c == col]
        fit = sum(p >= least for p in values)
        short = fit < recover and sum(p for p in values if p >= least) < share * sum(values)
        out |= {(r, col) for _, r in line[: recover if short else min(fit, most)]}
    return out


@pytest.mark.parametrize(("least", "most", "recover", "share"), [(0.01, 5, 0, 0.9), (0.05, 3, 8, 0.9), (0.2, 100, 4, 0.5), (0.0, 1, 0, 0.9)])
def test_columns_keep_their_strongest(spark, least, most, recover, share):
    rng = random.Random(5)
    cells = [(r, c, rng.random() ** 4) for c in range(6) for r in range(3 + 7 * c)] + [(r, 9, 0.25) for r in range(20)] + [(1, 10, 1e-12), (2, 10, 0.001)]
    got = motif.strongest(spark.createDataFrame(cells, CELLS), least, most, recover, share)
    assert sorted((r["row"], r["col"]) for r in got.collect()) == sorted(kept(cells, least, most, recover, share))


def test_strongest_of_nothing(spark):
    assert motif.strongest(spark.createDataFrame([], CELLS), 0.1, 3, 2).count() == 0
    assert motif.markov_clusters(spark.createDataFrame([], "a long, b long, weight double"), most=4).count() == 0


def test_squares_of_hubs_are_the_same(spark, monkeypatch):
    rng = random.Random(6)
    cells = {(0, c): 0.5 for c in range(40)} | {(rng.randrange(40), rng.randrange(40)): rng.random() for _ in range(150)}
    now = spark.createDataFrame([(r, c, p) for (r, c), p in cells.items()], CELLS)
    want: dict[tuple[int, int], float] = {}
    for (r, via), x in cells.items():
        for (other, c), y in cells.items():
            if other == via:
                want[r, c] = want.get((r, c), 0.0) + x * y
    for hub in (1 << 16, 7, 1):
        monkeypatch.setattr(motif, "HUB", hub)
        got = {(r["row"], r["col"]): r["p"] for r in motif._squared(now).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_short_columns_keep_cliques_apart(spark):
    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(3, 10, 0.05)]
    got = {r["node"]: r["cluster"] for r in motif.markov_clusters(spark.createDataFrame(cliques, "a long, b long, weight double"), most=3).collect()}
    assert len(got) == 12 and {got[k] for k in range(10, 16)}.isdisjoint({got[k] for k in range(6)})
