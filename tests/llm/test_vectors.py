import math
import tracemalloc

import numpy as np
import pyarrow as pa

from coclave.llm import vectors


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and float((x / np.abs(x).max()) @ (y / np.abs(y).max())) / (np.linalg.norm(x / np.abs(x).max()) * np.linalg.norm(y / np.abs(y).max())) >= least:
                links[a].append(b)
                links[b].append(a)
    seen, out = {}, []
    for k in links:
        stack, part = [k], {k}
        while stack:
            for n in links[stack.pop()]:
                if n not in part:
                    part.add(n)
                    stack.append(n)
        ids = [good[p][0] for p in part if good[p][0] is not None]
        seen[k] = min(ids) if ids else None
        out.append((good[k][0], len(links[k]), seen[k]))
    known = {id(v) for i, v in rows}
    bad = [(i, 0, i) for i, v in rows if not (v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v))]
    assert known
    return sorted(out + bad, key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(x) for x in base[k % 40] + rng.normal(size=16) * rng.choice([0, 0.2, 0.5])]) for k in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, rows[0][1]), (3, rows[3][1]), (1007, []), (1008, [1e200] * 16), (1009, [1e-200] * 16)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<double>, vector string, n int")
    got = vectors.near_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_many_blocks_and_skipped_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 16 * 6 * 8)
    monkeypatch.setattr(vectors, "PIECE", 8)
    monkeypatch.setattr(vectors, "FAN", 2)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.eye(6)[k % 6] + rng.normal(size=6) * 0.1]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()), key=str) == brute(rows)


def test_single_precision_columns(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 32 * 8 * 4)
    monkeypatch.setattr(vectors, "PIECE", 8)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in (base[k % 30] + rng.normal(size=8) * rng.choice([0, 0.15, 0.4])).astype(np.float32)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == brute(rows) and any(n for _, n, _ in got)


def test_distant_blocks_are_skipped(spark):
    n, width = 300, 0.3
    boxes = [(k, [float(k) / 4, 0.0], [float(k) / 4 + width, 1.0]) for k in range(n)]
    df = spark.createDataFrame(boxes, "block long, low array<double>, high array<double>")
    got = {(r["a"], r["b"]) for r in vectors.block_pairs(df, n, 0.447).collect()}
    want = {(a, b) for a in range(n) for b in range(a, n) if max(0.0, (b - a) / 4 - width) <= 0.447}
    assert got == want and len(got) < 0.02 * n * n


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"] is True


def test_a_dense_block_is_joined_in_bounded_memory():
    rng = np.random.default_rng(9)
    n, size = 16_384, 64
    raw = (rng.normal(size=size) + rng.normal(size=(n, size)) * 0.05).astype("<f4")
    payload = n.to_bytes(8, "little") + np.arange(n).tobytes() + np.ones(n, np.int64).tobytes() + raw.tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([payload], pa.binary()), pa.array([payload], pa.binary())], ["a", "b", "x", "y"])
    tracemalloc.start()
    done = next(vectors._join(iter([batch]), size, np.dtype("<f4"), 0.9, np.eye(size)[:, :8]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20, peak
    assert done.num_rows == n and set(done.column("root").to_pylist()) == {0} and set(done.column("links").to_pylist()) == {n - 1}


def test_pairs_near_the_threshold_are_decided_in_double_precision():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 5))
    one = vectors.units(x)
    exact = one @ one.T
    least = float(exact[3, 4])  # a pair right at it
    found = [(int(a), int(b)) for i, j in vectors.link_block_pair(one, one, True, least, np.eye(5)) for a, b in zip(i, j, strict=True)]
    dots = np.einsum("ik,jk->ij", one, one)
    want = {(a, b) for a in range(700) for b in range(a + 1, 700) if dots[a, b] >= least}
    assert len(found) == len(set(found)) and set(found) ^ want <= {(3, 4)}
