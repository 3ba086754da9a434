import pytest

from coclave.plans.find_scans import find_scans


@pytest.fixture(scope="module")
def tables(spark):
    genome = spark.createDataFrame([("7", "NC_7", 100), ("8", "NC_8", 50)], "scaffold string, refseq string, length long")
    hits = spark.createDataFrame(
        [(1, 1, "7", 0, 2, 0.01), (1, 1, "7", 2, 4, 0.2), (2, 1, "7", 98, 101, 0.01), (2, 1, "8", 1, 1, 0.01), (3, 1, "7", 5, 5, 0.01), (None, 1, "7", 9, 9, 0.01)],
        "cluster_id int, motif_num int, contig string, start int, stop int, pvalue double",
    )
    motifs = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (2, 1, 11), (3, 1, None)], "cluster_id int, motif_num int, gre_id int")
    return genome, hits, motifs


def test_forms(tables, tmp_path, spark):
    one = {(r["gre_id"], r["position"]): r["depth"] for r in find_scans(*tables, "7", form="series").collect()}
    assert one == {(g, p): 2 if p == 2 else 1 for g in (11, 12) for p in range(5)}
    assert {r["gre_id"] for r in find_scans(*tables, 7, stop=200, gre_ids=[11, 11], form="series").filter("position > 90").collect()} == {11}
    track = find_scans(*tables, "NC_8", path=str(tmp_path / "track")).collect()
    assert [tuple(r) for r in track] == [(1, 1, "+", "NC_8", 1, "GRE_11")]
    assert spark.read.csv(str(tmp_path / "track"), sep="\t", header=True).count() == 1
    named = find_scans(*tables, "7", 0, 4, max_p=0.05, form="hits").collect()
    assert sorted((r["gre_id"], r["motif_num"], r["start"]) for r in named) == [(11, 1, 0), (12, 2, 0)]


def test_wrong_names(tables):
    with pytest.raises(ValueError, match="7 .NC_7., 8 .NC_8."):
        find_scans(*tables, "9")
    with pytest.raises(ValueError, match="form is one of"):
        find_scans(*tables, "7", form="file")
    assert find_scans(*tables, "7", gre_ids=[]).count() == 0
