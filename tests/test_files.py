import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from coclave.plans.assemble import assemble
from coclave.sources import files, sinks
from coclave.streaming import follow_counts


def test_ratios(spark, tmp_path):
    text = "gene\tc1\tc2\tc3\nA\t1\t2\t3\nB\tNaN\t4\t\n"
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as f:
        f.write(text)
    got = {(r["row"], r["col"]): (r["raw"], r["std"]) for r in files.ratios(spark, str(tmp_path / "r.tsv.gz")).collect()}
    assert got["A", "c1"] == (1.0, -1.0) and got["B", "c1"] == (None, None) and got["B", "c2"] == (4.0, None)
    (tmp_path / "r.csv").write_text(text.replace("\t", ","))
    assert files.ratios(spark, str(tmp_path / "r.csv")).count() == 6
    (tmp_path / "bad").write_text("one\ntwo\n")
    with pytest.raises(ValueError):
        files.ratios(spark, str(tmp_path / "bad"))


def test_sequences_and_annotations(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">x NC_1 long name\nacg\ntta\n>y\nCC\n")
    assert {(r["refseq"], r["sequence"]) for r in files.fasta(spark, str(tmp_path / "g.fa")).collect()} == {("NC_1", "ACGTTA"), ("y", "CC")}
    (tmp_path / "a.tsv").write_text("id\tsysName\tdesc\n1\tg1\tgood\n2\tg2\t \n3\n4\tg9\tunknown\n")
    known = spark.createDataFrame([("g1",), ("g2",)], "name string")
    assert {tuple(r) for r in files.annotations(spark, str(tmp_path / "a.tsv"), known).collect()} == {("g1", "id", "1"), ("g1", "desc", "good"), ("g2", "id", "2")}


def test_hits_features_and_pairs(spark, tmp_path):
    head = "#pattern name\tsequence name\tstart\tstop\tstrand\tscore\tp-value\tmatched sequence\n"
    with bz2.open(tmp_path / "fimo-out-0007.bz2", "wt") as f:
        f.write(head + "1\tx.a_NC_000913.2\t5\t9\t+\t3.5\t1e-6\tacgt\n2\tx.a_NC_000913.2\t5\t9\t-\t1\t1e-3\tacgt\n")
    got = files.fimo(spark, str(tmp_path / "fimo-out-*.bz2")).collect()
    assert [(r["cluster"], r["motif_num"], r["contig"], r["start"], r["in_coding_rgn"]) for r in got] == [(7, 1, "NC_000913", 5, None)]
    (tmp_path / "f.tab").write_text("-- junk\n-- header\ntype\tcontig\tstart_pos\tend_pos\nCDS\tc\t<5\t>90\nSEQ_END\tc\t100\t100\n")
    assert [tuple(r) for r in files.features(spark, str(tmp_path / "f.tab")).collect()] == [("CDS", "c", 5, 90)]
    (tmp_path / "t.tsv").write_text("#Query ID\tTarget ID\tp-value\tOverlap\nm1\tm2\t10.0e-003\t7\n")
    assert tuple(files.motif_pairs(spark, str(tmp_path / "t.tsv")).first())[:4] == ("m1", "m2", 0.01, 7)
    (tmp_path / "b.csv").write_text("sample,block\n s1 , b1\n")
    assert tuple(files.blocks(spark, str(tmp_path / "b.csv")).first()) == ("s1", "b1")


def test_runs(spark, tmp_path):
    for run, finish in (("r1", "2020"), ("r2", None)):
        spark.createDataFrame([("eco", finish)], "organism string, finish_time string").write.parquet(f"{tmp_path}/{run}/run_infos")
        spark.createDataFrame([(1, "a"), (2, "b")], "iteration int, name string").write.parquet(f"{tmp_path}/{run}/row_members")
    folders = {r: f"{tmp_path}/{r}" for r in ("r1", "r2")}
    assert {(r["run_id"], r["name"]) for r in files.last_iteration(files.run_table(spark, folders, "row_members"), ["run_id"]).collect()} == {("r1", "b")}


def test_sinks(spark, tmp_path):
    names = spark.createDataFrame([("b",), ("a",), ("b",)], "name string")
    assert [tuple(r) for r in sinks.numbered(names, "row_id").orderBy("row_id").collect()] == [(1, "a"), (2, "b")]
    depth = spark.createDataFrame([(4, 7, 2), (4, 8, 1)], "gre_id int, position int, depth long")
    sinks.browser_track(depth, "NC_1", f"{tmp_path}/track")
    (part,) = (tmp_path / "track" / "id=GRE_4").glob("*.csv")
    assert part.read_text().splitlines() == ["start\tend\tstrand\tchr\tvalue", "7\t7\t+\tNC_1\t2", "8\t8\t+\tNC_1\t1"]
    pwm = spark.createDataFrame([("m", 1, 0.5, 0.5, 0.0, 0.0), ("m", 0, 0.25, 0.25, 0.25, 0.25)], "motif_id string, row int, a double, c double, g double, t double")
    sinks.meme_text(pwm, ["motif_id"], f"{tmp_path}/meme")
    text = "".join(p.read_text() for p in sorted((tmp_path / "meme").glob("*.txt")))
    lines = text.splitlines()
    assert lines[0] == "MEME version 3.0" and lines[7] == "A 0.284 C 0.216 G 0.216 T 0.284"
    assert lines[9:12] == ["letter-probability matrix: alength= 4 w= 2 nsites= 0", "0.250 0.250 0.250 0.250", "0.500 0.500 0.000 0.000"]
    exported = spark.createDataFrame([("m", 12, 0.00123)], "motif_id string, num_sites long, evalue double")
    sinks.meme_text(pwm, ["motif_id"], f"{tmp_path}/meme2", exported, F.col("motif_id"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "meme2").glob("*.txt")))
    assert "\nMOTIF m\nBL   MOTIF m width=0 seqs=0\nletter-probability matrix: alength= 4 w= 2 nsites= 12 E= 1.230e-03\n0.250" in text
    edges = spark.createDataFrame([(1, 9, 3, 0.5, 1.0, 0.5)], "corem_id int, a long, b long, weight double, density double, weighted_density double")
    cols = spark.createDataFrame([(1, 4, 0.01)], "corem_id int, col_id long, pval double")
    sinks.save_communities(edges, cols, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/corem_edges").first()["edge"] == "3-9" and spark.read.parquet(f"{tmp_path}/c/corem_cols").first()["col_id"] == 4
    for k in (1, 2):
        sinks.save(spark.createDataFrame([(k, k * 10)], "corem_id int, x int"), f"{tmp_path}/p", ["corem_id"], "overwrite")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_assembly(spark):
    groups = [(c, r) for c in range(40) for r in ((1, 2, 3) if c % 2 else (7, 8, 9))] + [(100, 1), (100, 7)]
    cells = spark.createDataFrame([(r, c, 5.0 + 0.01 * r if c == 0 else float((r * 7 + c * 3) % 11 + 1)) for r in range(30) for c in range(4)], "row_id long, col_id long, raw double")
    got = assemble(spark.createDataFrame(groups, "cluster_id long, row_id long"), cells, cutoff=0.6, thresholds=[0.3, 0.6], resamples=60)
    members = {}
    for r in got.corem_rows.collect():
        members.setdefault(r["corem_id"], set()).add(r["row_id"])
    assert sorted(map(sorted, members.values())) == [[1, 2, 3], [7, 8, 9]]
    assert got.corem_cols.filter("pval > 0.05").count() == 0 and got.densities.count() == 2


def test_followed_counts(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "cluster_id long, row_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("cluster_id long, row_id long").parquet(f"{tmp_path}/in")
    follow_counts(stream, "row_id", "followed", f"{tmp_path}/ck").awaitTermination()
    assert {tuple(r) for r in spark.table("followed").collect()} == {(5, 2), (6, 1)}
