import random

import pytest
from pyspark.sql import functions as F

from coclave.operators import blocks, communities, corem, expression, graph, interval, motif, names, resample, select
from coclave.operators.components import components
from coclave.operators.enrich import enrichment


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bridge(spark):
    held = {1: "abc", 2: "ab", 3: "bc", 4: "d", 5: "ad"}
    return spark.createDataFrame([(c, x) for c, xs in held.items() for x in xs], "cluster_id long, row_id string")


def test_membership(spark, bridge):
    groups = bridge.select("cluster_id").distinct()
    pick = lambda logic, want=("a", "b"): {r[0] for r in select.members(groups, bridge, "row_id", list(want), logic).collect()}
    assert pick("or") == {1, 2, 3, 5} and pick("and") == {1, 2} and pick("nor") == {4}
    assert pick("and") <= pick("or") and pick("or") | pick("nor") == {1, 2, 3, 4, 5} and pick("and", "aab") == {1, 2}
    with pytest.raises(ValueError):
        pick("xor")
    assert select.kind_of("Genes") == "row" and select.kind_of("bicluster") == "cluster"
    with pytest.raises(ValueError):
        select.kind_of("planet")


def test_enrichment_corrects_before_it_cuts(spark, bridge):
    groups = bridge.select("cluster_id").distinct()
    chosen = select.members(groups, bridge, "row_id", ["a"], "or")
    whole = {r["key"]: r for r in enrichment(bridge, "row_id", chosen, groups, cutoff=None).collect()}
    assert {k: (r["counts"], r["all_counts"]) for k, r in whole.items()} == {"a": (3, 3), "b": (2, 3), "c": (1, 2), "d": (1, 2)}
    assert whole["a"]["pval"] == 0 and whole["b"]["pval"] == pytest.approx(0.1)
    cut = {r["key"]: r for r in enrichment(bridge, "row_id", chosen, groups, cutoff=0.1).collect()}
    assert set(cut) == {"a", "b"} and cut["b"]["qval_bonferroni"] == pytest.approx(0.4)


def test_names(spark):
    info = spark.createDataFrame([(1179, "Rv1180", "e1", 234.0, "sys1"), (1180, "Rv1181", "e2", 456.0, "sys2"), (1181, "Rv1182", "e3", 723.0, "sys3")], "row_id long, name string, alias string, gi double, sys string")
    fields = ["row_id", "name", "alias", "gi", "sys"]
    for name in (1180, "Rv1181", "e2", 456.0, "sys2"):
        assert [r["row_id"] for r in names.by_any_field(info, [name], fields).collect()] == [1180]
    assert names.by_any_field(info, ["nothing"], fields).count() == 0
    got = names.by_field(info, ["sys3", "sys1", "sys3"], "sys", "name").orderBy("pos").collect()
    assert [r["name"] for r in got] == ["Rv1182", "Rv1180"]
    with pytest.raises(KeyError):
        names.by_field(info, ["sys9"], "sys", "name")
    with pytest.raises(ValueError):
        names.by_field(info, ["sys1"], "sys", "sys")


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (200, 150), (50, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)]
        part = {}

        def find(x, part=part):
            while part.setdefault(x, x) != x:
                x = part[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
        rng.shuffle(edges)
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in {v for e in edges for v in e}}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_graph_on_hand_made_edges(spark):
    path = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a long, b long, weight double")
    for d in (0, 1):
        assert rows(graph.edge_similarity(path, d)) == [(2, 1, 3, 0.33333)]
    star = spark.createDataFrame([(0, k, c) for k, c in enumerate((7, 1, 1, 1), 1)], "src long, dst long, counts long")
    got = {r["dst"]: round(r["pval"], 6) for r in graph.backbone_pval(graph.weigh(star)).collect()}
    assert got == {1: 0.027, 2: 0.729, 3: 0.729, 4: 0.729}
    alone = graph.backbone_pval(graph.weigh(spark.createDataFrame([(0, 1, 5)], "src long, dst long, counts long"))).first()
    assert alone["weight"] == 1 and alone["pval"] == 1
    parallel = spark.createDataFrame([("x", "y", 3.0), ("y", "x", 4.0), ("x", "x", 9.0)], "a string, b string, weight double")
    assert rows(graph.combine_parallel(parallel)) == [("x", "x", 9.0), ("x", "y", 7.0)] and rows(graph.combine_parallel(parallel, "max")) == [("x", "x", 9.0), ("x", "y", 4.0)]


def test_triangle_is_one_community(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (7, 8, 1.0)], "a long, b long, weight double")
    labelled = communities.link_communities(edges, graph.edge_similarity(edges), [0.5, 0.9])
    assert {r["community"] for r in labelled.filter("threshold = 0.5 and b < 4").collect()} == {0}
    d = {r["threshold"]: r for r in communities.partition_densities(communities.community_stats(labelled)).collect()}
    assert d[0.5]["communities"] == 2 and d[0.5]["d1"] == pytest.approx(2 * 3 * 0.5 / 4) and d[0.5]["d2"] == pytest.approx(1.0)
    assert communities.best_threshold(communities.partition_densities(communities.community_stats(labelled))).first()["threshold"] == 0.5
    kept = communities.corems(labelled.filter("threshold = 0.5"))
    assert {(r["corem_id"], r["density"]) for r in kept.collect()} == {(1, 1.0)} and communities.corem_rows(kept).count() == 3


def test_higher_thresholds_refine(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame(sorted({(a, b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(60)) if a < b}), "a long, b long").withColumn("weight", (F.col("a") + F.col("b") + 1) / 40)
    got = communities.link_communities(edges, graph.edge_similarity(edges), [0.2, 0.5]).collect()
    low, high = ({(r["a"], r["b"]): r["community"] for r in got if r["threshold"] == t} for t in (0.2, 0.5))
    for e in high:
        for f in high:
            if high[e] == high[f]:
                assert low[e] == low[f]


def test_intervals(spark):
    hits = spark.createDataFrame([(1, "c", 1, 3, 0.1), (2, "c", 2, 4, 0.2), (3, "d", 30, 40, 0.3)], "hit_id long, contig string, start int, stop int, pvalue double")
    assert rows(interval.depth(hits, ["contig"]).filter("contig = 'c'")) == [("c", 1, 1), ("c", 2, 2), ("c", 3, 2), ("c", 4, 1)]
    assert [r["hit_id"] for r in interval.stabbing(hits, 3, 0.15).collect()] == [1] and interval.stabbing(hits, 3, 1.0, "d").count() == 0
    assert {r["hit_id"] for r in interval.contained(hits, 1, 4, "c").collect()} == {1, 2}
    marks = spark.createDataFrame([("c", 10, 20), ("c", 15, 30), ("c", 15, 30), ("d", 38, 5000)], "contig string, start_pos int, end_pos int")
    assert rows(interval.covered(marks)) == [("c", 20), ("d", 4962)]
    assert rows(interval.flag_points(hits, ["start", "stop"], marks).select("hit_id", "in_coding_rgn")) == [(1, False), (2, False), (3, True)]


def test_resampling(spark):
    cells = spark.createDataFrame([(r, c, float(r * c % 7 + 1)) for r in range(30) for c in range(3)], "row_id long, col_id long, raw double")
    nulls = resample.lowest_rsd(cells, 4, 40, 0.1)
    assert all(len(r["lowest"]) == 4 and r["lowest"] == sorted(r["lowest"]) for r in nulls.collect())
    assert rows(nulls) == rows(resample.lowest_rsd(cells.repartition(7), 4, 40, 0.1))
    old = spark.createDataFrame([(1, 4, 20, [0.2, 0.5])], "col_id long, nrows int, resamples int, lowest array<double>")
    new = spark.createDataFrame([(1, 4, 20, [0.1, 0.9])], old.schema)
    assert resample.merge(old, new).first()["lowest"] == [0.1, 0.2, 0.5, 0.9]
    stored = spark.createDataFrame([(k, 30, [0.1, 0.2, 0.3]) for k in range(4)], "col_id long, resamples int, lowest array<double>")
    seen = spark.createDataFrame([(0, 0.05), (1, 0.25), (2, 0.9), (3, None)], "col_id long, rsd double")
    got = {r["col_id"]: r["pval"] for r in resample.empirical_pvalue(seen, stored, cutoff=None).collect()}
    assert got == {0: pytest.approx(1 / 30), 1: pytest.approx(2 / 30), 2: 0.1}
    assert [r["col_id"] for r in resample.missing_nulls(spark.range(6).withColumnRenamed("id", "col_id"), old, 4, 20).orderBy("col_id").collect()] == [0, 2, 3, 4, 5]


def test_blocks(spark):
    assert [[*r] for r in blocks.split_bins(6, 4)] == [[0], [1, 2], [3], [4, 5]] and [len(r) for r in blocks.split_bins(6, 6)] == [1] * 6
    got = spark.range(50).select(blocks.bin_of(F.col("id"), F.lit(50), 7).alias("b")).collect()
    assert [r["b"] for r in got] == [k for k, r in enumerate(blocks.split_bins(50, 7)) for _ in r]
    assert blocks.set_combinations(["a", "b"]) == [(), ("a",), ("b",), ("a", "b")]
    runs = blocks.pick_columns({"x": ["1", "2"], "y": ["3"], "z": ["2", "4"]}, [["z"]], 5, 3, 0.1)
    assert len(runs) == 5 and all(not {"2", "4"} & set(r["cols"]) and r["excluded"] == "z" for r in runs) and runs == blocks.pick_columns({"x": ["1", "2"], "y": ["3"], "z": ["2", "4"]}, [["z"]], 5, 3, 0.1)
    heavy = blocks.weighted_sample(spark.range(20), "id", F.when(F.col("id") < 3, 1e6).when(F.col("id") < 6, 0.0).otherwise(1e-6), 3)
    assert {r["id"] for r in heavy.collect()} == {0, 1, 2}


def test_corem_lookups(spark):
    held = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 9)], "corem_id int, row_id long")
    assert rows(corem.choose(held, held, "row_id", [2, 3], "and")) == [(1,), (2,)] and rows(corem.choose(held, held, "corem_id", [3], "nor")) == [(1,), (2,)]
    assert rows(corem.shared(held, "row_id", corem.choose(held, held, "row_id", [2], "or"), "and")) == [(2, 2), (3, 2)]
    assert [r["size"] for r in corem.sizes(held).collect()] == [1, 2, 3]


def test_matrices_and_motifs(spark):
    cells = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 5.0)], "row_id long, col_id long, raw double")
    assert {(r["row_id"], r["col_id"]): r["std"] for r in expression.zscore(cells).collect()} == {(1, 1): -1.0, (1, 2): 0.0, (1, 3): 1.0, (2, 1): None}
    assert [tuple(r) for r in expression.slice_wide(cells, [1, 2], [3, 1]).collect()] == [(1, 1.0, 3.0), (2, 5.0, None)]
    named = spark.range(1).select(motif.motif_id(F.lit("a_b"), F.lit(3), F.lit(1)).alias("m")).select("m", motif.parse_motif_id(F.col("m")).alias("p")).first()
    assert named["m"] == "a_b_003_01" and tuple(named["p"]) == ("a_b", 3, 1)
    lines = spark.createDataFrame([(0, "a\tb\tc\td"), (1, "e\tf"), (2, "g\th\ti\tj\tk")], "pos int, line string")
    assert {r["motif"]: r["gre_id"] for r in motif.numbered_clusters(lines).collect()} == dict.fromkeys("abcd", 1) | dict.fromkeys("ghijk", 2)


def test_markov_clusters_keep_cliques_apart(spark):
    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10, 0.05)]
    got = {r["node"]: r["cluster"] for r in motif.markov_clusters(spark.createDataFrame(cliques, "a long, b long, weight double")).collect()}
    assert {got[k] for k in range(4)} == {0} and {got[k] for k in range(10, 14)} == {10}
