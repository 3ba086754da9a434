import hashlib
import math
import random

import pytest

from coclave.operators import resample
from coclave.plans.assemble import corem_columns
from coclave.sources.versioned import Versioned


def stream(seed, col, draw, n, size):
    out, b = [], 0
    while len(out) < size:
        h = hashlib.md5(f"{seed}|{col}|{draw}|{b}".encode()).hexdigest()
        for k in range(4):
            x = math.floor(int(h[8 * k : 8 * k + 8], 16) / 2**32 * n)
            if x not in out:
                out.append(x)
        b += 1
    return out[:size]


def uniform(seed, *parts):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16) / 2**48


def rsd(values):
    mean = sum(values) / len(values)
    return abs(math.sqrt(sum((x - mean) ** 2 for x in values) / len(values)) / mean) if mean else None


def drawn(cells, col, draw, size, seed=1):
    """The values of a draw, by the definition."""
    own = sorted((r, v) for r, c, v in cells if c == col and v is not None)
    if len(own) >= 2 * size:
        return [own[k][1] for k in stream(seed, col, draw, len(own), size)]
    return [v for r, v in sorted(own, key=lambda x: (uniform(seed, col, x[0], draw), x[0]))[:size]]


def matrix(seed=1):
    rng = random.Random(seed)
    cells = [(r, c, rng.choice([rng.gauss(5, 2), 3.0])) for c, n in ((0, 60), (1, 21), (2, 9), (3, 3), (4, 1)) for r in range(n)]
    return [*cells, (100, 0, None), (101, 5, None)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(matrix(), "row_id int, col_id int, raw double")


def test_every_size_is_a_prefix_of_one_draw(spark, cells):
    sizes, resamples, keep = [1, 3, 4, 10, 25], 12, 0.5
    found = {(r["col_id"], r["nrows"]): r["lowest"] for r in resample.lowest_of_sizes(cells, sizes, resamples, keep).collect()}
    for col in range(5):
        for size in sizes:
            want = sorted(round(rsd(drawn(matrix(), col, d, size)), 12) for d in range(resamples))[: round(resamples * keep)]
            assert found.pop((col, size)) == pytest.approx(want, abs=2e-12), (col, size)
    assert not found
    for size in sizes:
        alone = {r["col_id"]: r["lowest"] for r in resample.lowest_rsd(cells.repartition(5), size, resamples, keep).collect()}
        together = {r["col_id"]: r["lowest"] for r in resample.lowest_of_sizes(cells, sizes, resamples, keep).filter(f"nrows = {size}").collect()}
        assert alone == together


def test_corem_columns_are_those_of_each_size_alone(spark, cells):
    held = spark.createDataFrame([(k, r) for k, members in enumerate(([0, 1, 2], [3, 4, 5, 6], [0, 5, 8], list(range(12)), [900])) for r in members], "corem_id int, row_id int")
    found = sorted((r["corem_id"], r["col_id"], round(r["pval"], 9)) for r in corem_columns(held, cells, 40, 0.5, 0.5).collect())
    want, data = [], {(r, c): v for r, c, v in matrix()}
    for k in range(5):
        members = [r["row_id"] for r in held.filter(f"corem_id = {k}").collect()]
        for col in range(6):
            values = [data[r, col] for r in members if data.get((r, col)) is not None]
            if not values or not any(c == col and v is not None for _, c, v in matrix()):
                continue
            low = sorted(round(rsd(drawn(matrix(), col, d, len(members))), 12) for d in range(40))[:20]
            below = sum(x <= rsd(values) for x in low)
            p = 0.5 if below >= 20 else 1 / 40 if not below else below / 40
            if p <= 0.5:
                want.append((k, col, round(p, 9)))
    assert found == sorted(want)


def test_one_plan_whatever_the_sizes(spark, cells):
    empty = spark.createDataFrame([], "corem_id int, row_id int")
    assert corem_columns(empty, cells, 10, 0.1, 0.05).count() == 0
    none = spark.createDataFrame([], "row_id int, col_id int, raw double")
    assert resample.lowest_of_sizes(none, [2, 3], 5).count() == 0


def wanted(spark):
    return spark.createDataFrame([(c, s) for c in range(5) for s in (3, 4, 10)], "col_id int, nrows int")


def listed(df):
    return sorted((r["col_id"], r["nrows"], r["resamples"], tuple(r["lowest"])) for r in df.collect())


def test_topped_up_in_two_steps_equals_drawn_at_once(spark, cells, tmp_path):
    table = Versioned(spark, str(tmp_path / "nulls"), lambda: resample.F.col("nrows"))
    first = resample.store_nulls(table, cells, wanted(spark).filter("nrows < 10"), 8, 0.5)
    assert {r["resamples"] for r in first.collect()} == {8} and table.version() == 1
    done = resample.store_nulls(table, cells, wanted(spark), 20, 0.5)
    at_once = resample.lowest_of_sizes(cells, [3, 4, 10], 20, 0.5)
    assert listed(done) == listed(at_once)
    lacking = resample.shortfall(wanted(spark), table.read(1), 20, 0.5).collect()
    assert {(r["nrows"], r["first"], r["count"]) for r in lacking} == {(3, 8, 12), (4, 8, 12), (10, 0, 20)}
    # Nothing lacks: nothing is written.
    assert listed(resample.store_nulls(table, cells, wanted(spark), 20, 0.5)) == listed(at_once) and table.version() == 2
    assert resample.store_nulls(table, cells, wanted(spark), 5, 0.5).first()["resamples"] == 20


def test_a_record_that_reserved_too_little_or_has_another_seed_is_drawn_anew(spark, cells):
    little = resample.top_up(None, cells, wanted(spark), 8, 0.5, reserve=4)
    assert {r["reserve"] for r in little.collect()} == {4}
    assert {(r["first"], r["count"]) for r in resample.shortfall(wanted(spark), little, 20, 0.5).collect()} == {(0, 20)}
    grown = resample.top_up(little, cells, wanted(spark), 20, 0.5)
    assert listed(resample.kept_share(grown, 0.5)) == listed(resample.lowest_of_sizes(cells, [3, 4, 10], 20, 0.5))
    other = resample.top_up(grown, cells, wanted(spark), 20, 0.5, seed=2)
    assert listed(resample.kept_share(other, 0.5)) == listed(resample.lowest_of_sizes(cells, [3, 4, 10], 20, 0.5, seed=2))


def test_versions_are_seen_whole_and_only_touched_parts_are_written(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"), lambda: resample.F.col("k") % 3)
    assert table.read() is None and table.version() == 0
    rows = spark.range(9).selectExpr("id AS k", "'old' AS v")
    assert table.upsert(rows, ["k"]) == 1
    before = table._read_list(1)["parts"]
    assert table.upsert(spark.createDataFrame([(3, "new"), (12, "new")], "k long, v string"), ["k"]) == 2
    after = table._read_list(2)["parts"]
    assert before["1"] == after["1"] and before["2"] == after["2"] and before["0"] != after["0"]
    assert sorted(map(tuple, table.read().collect())) == sorted([(k, "new" if k in (3, 12) else "old") for k in [*range(9), 12]])
    assert sorted(map(tuple, table.read(1).collect())) == [(k, "old") for k in range(9)]
    with pytest.raises(FileExistsError):
        table.replace(rows, since=1)
    assert table.read().count() == 10
    assert table.replace(rows.filter("k < 0"), whole=True) == 3 and table.read().count() == 0
    odd = Versioned(spark, str(tmp_path / "odd"), lambda: resample.F.col("p"))
    odd.replace(spark.createDataFrame([("a/b=c d%", 1), (None, 2), ("", 3)], "p string, n int"))
    assert sorted(r["n"] for r in odd.read().collect()) == [1, 2, 3] and odd.read(parts=["a/b=c d%"]).count() == 1
