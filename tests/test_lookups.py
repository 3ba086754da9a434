import random

import pytest
from pyspark.sql import functions as F

from coclave.functions.stats import list_text, now_millis, text_list
from coclave.operators import blocks, interval, motif, resample
from coclave.operators.number import in_order
from coclave.plans.corem_info import Corems, corem_info, corem_kind
from coclave.runtime import shared_dir
from coclave.sources import files, sinks


def test_numbers_follow_the_order(spark):
    names = [f"n{k * 7919 % 1000:03d}" for k in range(1000)]
    got = in_order(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), ["name"], "k", 5).collect()
    assert sorted((r["k"], r["name"]) for r in got) == list(enumerate(sorted(names), 5))
    assert in_order(spark.createDataFrame([], "name string"), ["name"], "k").count() == 0


@pytest.fixture(scope="module")
def corems(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 2, 3), (2, 3, 4), (2, 2, 4)], "corem_id int, a long, b long")
    rows = edges.select("corem_id", F.explode(F.array("a", "b")).alias("row_id")).distinct()
    cols = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "corem_id int, col_id long")
    info = spark.createDataFrame([(k, f"name{k}", f"g{k}") for k in range(1, 6)], "row_id long, name string, sys_name string")
    return Corems(edges, rows, cols, info, spark.createDataFrame([(7, "hot"), (8, "cold")], "col_id long, name string"))


def test_corem_lookups_by_any_part(corems):
    ask = lambda *a, **k: [tuple(r) for r in corem_info(corems, *a, **k).collect()]
    assert ask("g3-g2", "edges", "corem") == [(1,), (2,)] == ask(["name2", "g3"], "genes", "corem", logic="and")
    assert ask(["g2-g1"], "edge", "genes") == [("g1",), ("g2",), ("g3",)] and ask(["g1"], "genes", "corem", logic="nor") == [(2,)]
    assert ask([1, 2], "corem_id", "genes", logic="and") == [("g2",), ("g3",)] and ask([1, 2], count=True)[:2] == [("g2", 2), ("g3", 2)]
    assert ask("cold", "conditions", "edges", y_field="name") == [("name2-name3",), ("name2-name4",), ("name3-name4",)] and ask(1, "corem", "conditions") == [("hot",)]
    with pytest.raises(KeyError):
        ask("nobody", "genes")
    with pytest.raises(ValueError):
        corem_kind("gre")


def test_depth_across_ranges_and_masks(spark):
    rng = random.Random(2)
    hits = [(c, s, s + rng.randint(0, 90)) for c, s in ((rng.choice("xy"), rng.randint(-50, 400)) for _ in range(60))]
    want = {}
    for c, s, e in hits:
        for p in range(s, e + 1):
            want[c, p] = want.get((c, p), 0) + 1
    frame = spark.createDataFrame(hits, "contig string, start int, stop int")
    for stretch in (16, 64, 1 << 16):
        assert {(r["contig"], r["position"]): r["depth"] for r in interval.depth(frame, ["contig"], stretch).collect()} == want
    marks = frame.select("contig", F.col("start").alias("start_pos"), F.col("stop").alias("end_pos"))
    points = spark.createDataFrame([(k, c, p, q) for k, (c, p, q) in enumerate((rng.choice("xyz"), rng.randint(-80, 600), rng.randint(-80, 600)) for _ in range(300))] + [(999, None, None, 5)], "hit_id long, contig string, start int, stop int")
    got = interval.flag_points(points, ["start", "stop"], marks).collect()
    assert len(got) == 301 and all(r["in_coding_rgn"] == ((r["contig"], r["start"]) in want or (r["contig"], r["stop"]) in want) for r in got)
    open_ = {(c, p) for c, s, e in hits for p in range(s, e)}
    assert {r["contig"]: r["covered"] for r in interval.covered(marks).collect()} == {c: sum(x == c for x, _ in open_) for c in "xy"}


def test_draws_are_without_replacement(spark):
    places = spark.range(200).select(F.explode(F.array(*(F.lit(n) for n in (10, 40, 1000)))).alias("n"), F.col("id").alias("draw")).withColumn("at", resample.drawn_positions(3, F.lit("c"), F.col("draw"), F.col("n"), 5)).collect()
    assert all(len(set(r["at"])) == 5 and 0 <= min(r["at"]) <= max(r["at"]) < r["n"] for r in places)
    seen = [p for r in places if r["n"] == 10 for p in r["at"]]
    assert all(60 < seen.count(p) < 140 for p in range(10))


def test_motif_exports_and_sites(spark):
    motifs = spark.createDataFrame([(1, 1, 0.01), (1, 2, 5.0), (2, 1, 0.02)], "cluster_id long, motif_num int, evalue double")
    sites = spark.createDataFrame([(1, 1, 0.1), (1, 1, None), (1, 2, 0.1), (2, 1, 0.3)], "cluster_id long, motif_num int, pvalue double")
    clusters = spark.createDataFrame([(1, 0.5), (2, 0.9)], "cluster_id long, residual double")
    bridge = spark.createDataFrame([(1, 7), (2, 8)], "cluster_id long, row_id long")
    ask = lambda **k: sorted((r["cluster_id"], r["motif_num"], r["num_sites"]) for r in motif.exportable(motifs, sites, clusters, **k).collect())
    assert ask() == [(1, 1, 1), (1, 2, 1), (2, 1, 1)] and ask(max_residual=0.6) == [(1, 1, 1), (1, 2, 1)] and ask(max_evalue=1.0, bridge=bridge, row_id=8) == [(2, 1, 1)]
    named, children = motif.load_motifs(motifs, {"sites": sites})
    assert sorted(r["motif_info_id"] for r in named.collect()) == [1, 2, 3] and sorted(r["motif_info_id"] for r in children["sites"].collect()) == [1, 1, 2, 3]
    many = [(c, n, 0.1 * k, k) for c, n, often in (("big", "a", 6), ("big", "b", 7), ("big", "c", 8), ("big", "d", 5), ("few", "a", 6), ("few", "b", 3), ("few", "c", 2)) for k in range(often)]
    sizes = spark.createDataFrame([("big", 101), ("few", 10)], "cluster string, motifs long")
    best = {(r["cluster"], r["name"]): (r["start"], r["n"]) for r in motif.best_sites(spark.createDataFrame(many, "cluster string, name string, pvalue double, start int"), sizes).collect()}
    assert best == {("big", "a"): (0, 6), ("big", "b"): (0, 7), ("big", "c"): (0, 8), ("few", "a"): (0, 6), ("few", "b"): (0, 3)}


def test_evalues(spark):
    texts = {"10.0e+003": "1.0e+004", "1.2e-005": "1.2e-005", "25.0e-002": "2.5e-001", "12.0e+000": "1.2e+001", "nothing": "nothing", "": ""}
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", motif.renormalised(F.col("t")).alias("x")).collect()}
    assert got == texts


def test_column_picks_follow_the_groups():
    held = {f"b{k}": [f"c{k}_{j}" for j in range(3)] for k in range(8)}
    together = {(x, y): 1000.0 for x in ("b0", "b1") for y in ("b0", "b1") if x != y}
    runs = blocks.pick_columns(held, [["b7"]], 60, 6, 0.0, together=together)
    begun = [r for r in runs if r["blocks"][0] in ("b0", "b1")]
    assert len(begun) > 5 and sum({"b0", "b1"} <= set(r["blocks"]) for r in begun) > 0.8 * len(begun) and all("b7" not in r["blocks"] and len(r["cols"]) >= 3 for r in runs)
    groups = blocks.random_exclusions({b: 3 for b in held}, 5, 100)
    assert len(groups) == 5 and all(len(g) == 4 for g in groups) and groups == blocks.random_exclusions({b: 3 for b in held}, 5, 100)
    with pytest.raises(ValueError):
        blocks.random_exclusions({"x": 0}, 1, 100)


def test_upserts_and_small_readers(spark):
    old = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.6)], "a long, b long, weight double")
    new = spark.createDataFrame([(1, 3, 0.9), (4, 5, 0.1)], "a long, b long, weight double")
    assert sorted(map(tuple, sinks.upsert(old, new, ["a", "b"]).collect())) == [(1, 2, 0.5), (1, 3, 0.9), (4, 5, 0.1)]
    infos = spark.createDataFrame([(None,), ("511145",)], "ncbi_code string")
    assert files.organism_code(infos) == "511145" and files.organism_code(infos.limit(0)) is None
    row = spark.range(1).select(text_list(list_text(F.array(F.lit(0.5), F.lit(2.0)))).alias("x"), now_millis().alias("now")).first()
    assert row["x"] == [0.5, 2.0] and row["now"] > 1_600_000_000_000


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://there:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        shared_dir(Session)
