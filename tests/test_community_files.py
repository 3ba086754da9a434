import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("lines, counts", [
    ([], {"wpairs": 0, "tanimoto": 0, "clusters": 0, "density": 0, "communities": 0, "corem_rows": 0}),
    # An edge that makes no corem.
    ([(c, r) for c in range(9) for r in (1, 2)] + [(9, 1), (9, 3)], {"wpairs": 1, "tanimoto": 0, "clusters": 2, "density": 2, "communities": 0, "corem_rows": 0}),
])
def test_files_without_rows(spark, tmp_path, lines, counts):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["file"]: (r["n"], r["ids"]) for r in entry.queries()["sink_community_files"](spark, str(tmp_path)).collect()}
    assert {name: n for name, (n, _) in got.items()} == counts
    assert all(ids is None for n, ids in got.values() if n == 0)
