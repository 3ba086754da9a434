import random
import time
from collections import defaultdict

import pytest

from coclave.operators import communities, graph


def tables(edges, definition):
    """(keystone, i, j) to similarity, by the definition."""
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    full = {n: {**own, n: sum(own.values()) / len(own) if definition == 0 else 1.0} for n, own in near.items()}
    dot = lambda x, y: sum(w * full[y][k] for k, w in full[x].items() if k in full[y])
    out = {}
    for key, own in near.items():
        for i in own:
            for j in own:
                if i < j:
                    d = dot(i, j)
                    out[key, i, j] = d / (dot(i, i) + dot(j, j) - d)
    return out


def random_edges(seed, heavy=1.0):
    rng = random.Random(seed)
    edges = {}
    for _ in range(70):
        a, b = sorted(rng.sample(range(22), 2))
        edges[a, b] = heavy * rng.choice([rng.random() + 1e-3, 0.5, 10 ** -rng.randint(0, 4)])
    for k in range(25):  # leaves of a hub
        edges[5, 100 + k] = heavy * rng.choice([rng.random() + 1e-3, 0.25, 0.25, 1e-3])
    return [(a, b, w) for (a, b), w in sorted(edges.items())]


@pytest.mark.parametrize("definition", [0, 1])
def test_pairs_from_a_least_similarity_on(spark, definition):
    edges = random_edges(definition)
    df, want = spark.createDataFrame(edges, "a long, b long, weight double"), tables(edges, definition)
    whole = {(r["keystone"], r["i"], r["j"]): r["similarity"] for r in graph.edge_similarity(df, definition).collect()}
    assert whole == pytest.approx(want, abs=6e-6)
    for least in (0.05, 0.3, 0.7, 1.0):
        got = {(r["keystone"], r["i"], r["j"]): r["similarity"] for r in graph.edge_similarity(df, definition, least).collect()}
        assert got == {k: v for k, v in whole.items() if v >= least}


@pytest.mark.parametrize(("definition", "heavy"), [(0, 1.0), (1, 1.0), (1, 9.0)])
def test_links_connect_what_all_pairs_connect(spark, definition, heavy):
    df = spark.createDataFrame(random_edges(7 + definition, heavy), "a long, b long, weight double")
    cuts = [0.1, 0.2, 0.3, 0.4, 0.6, 0.9]
    whole, few = graph.edge_similarity(df, definition), graph.edge_links(df, definition, min(cuts))
    assert {tuple(r) for r in few.collect()} <= {tuple(r) for r in whole.collect()}
    of = lambda s: sorted(tuple(r) for r in communities.link_communities(df, s, cuts).collect())
    assert of(few) == of(whole)


def test_a_star_of_many_edges_is_linked_in_bounded_time(spark):
    n = 20_000
    star = spark.range(n).selectExpr("0L AS a", "id + 1 AS b", "(id % 997 + 1) / 997 AS weight")
    began = time.time()
    for definition in (0, 1):
        links = graph.edge_links(star, definition, 0.2)
        assert 0 < links.count() <= n
    assert time.time() - began < 120
    assert communities.link_communities(star, graph.edge_links(star, 0, 0.2), [0.2]).select("community").distinct().count() == 1
