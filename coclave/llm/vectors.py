"""Near-duplicate vectors by an epsilon grid order join, exact at the cosine threshold.

On unit vectors a cosine of t or more is a distance of at most epsilon = sqrt(2 - 2t). Vectors are sorted by their grid cells of
side epsilon along the leading principal directions; the sequence is cut into blocks, blocks into a tree of intervals. Pairs of
intervals are expanded from the root down, each level by joins on the parent, and skipped when their bounding boxes are further
apart than epsilon, which orthogonal projection proves for all their members. Pairs of blocks that remain are split once more
inside a task and multiplied out: single precision finds what can reach the threshold, double precision decides. A block holds
vectors in the precision they are stored in, as many as fit a number of bytes.

Equal vectors are one class from the start. A pair of blocks gives each linked class its number of links and a representative of
its component in the pair, so at most one row per class, however many links there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from coclave.operators.components import components
from coclave.runtime import cut, mapped, ready

LEADING, PIECE, FAN = 8, 128, 16
#: Bytes of vectors in a block, which travel together: the bytes moved for all pairs of blocks fall as this grows.
BLOCK_BYTES = 4 << 20
#: Pairs near the threshold that are decided in double precision at a time.
NEAR = 1 << 16
MASK = (1 << 33) - 1


def linkable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _values(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def units(values: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision whatever they are stored in."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values**2).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size + 1, size))
    for batch in batches:
        if batch.num_rows:
            u = units(_values(batch.column(0), size))
            total[0] += u.sum(0)
            total[1:] += u.T @ u
    yield pa.RecordBatch.from_arrays([pa.array([int(np.random.default_rng().integers(16))], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"slot": table.column("slot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _project(batches: Iterator[pa.RecordBatch], size: int, axes: np.ndarray, epsilon: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _values(batch.column(2), size)
        cells = np.floor(units(values) @ axes / epsilon).astype(np.int32) if len(values) else np.zeros((0, 1), np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in values], pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))], ["cls", "n", "raw", "cells"]
        )


def _pack(size: int, kind: np.dtype, axes: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("position").to_numpy(), kind="stable")
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(-1, size)[order]
        at = units(raw) @ axes
        ids, n = (table.column(c).to_numpy()[order] for c in ("cls", "n"))
        return pa.table(
            {
                "block": table.column("block")[:1],
                "payload": pa.array([len(ids).to_bytes(8, "little") + ids.tobytes() + n.tobytes() + raw.tobytes()], pa.binary()),
                "low": pa.array([at.min(0)], pa.list_(pa.float64())),
                "high": pa.array([at.max(0)], pa.list_(pa.float64())),
            }
        )

    return pack


def _unpack(payload: pa.Buffer, size: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(payload[:8].to_pybytes(), "little")
    ids, n = np.frombuffer(payload, np.int64, 2 * k, offset=8).reshape(2, k)
    return ids, n, units(np.frombuffer(payload, kind, offset=8 + 16 * k).reshape(k, size))


def link_block_pair(one: np.ndarray, two: np.ndarray, same: bool, least: float, axes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of linked unit vectors, each pair once, a piece of `one` at a time; pieces whose boxes are too far apart are skipped.

    Single precision decides what it can, within the bound of its error; the rest is decided in double, NEAR pairs at a time.
    """
    epsilon = np.sqrt(2 - 2 * least) + 1e-9
    slack = max(1e-4, 6.1e-8 * (one.shape[1] + 4))
    starts_a, starts_b = range(0, len(one), PIECE), range(0, len(two), PIECE)
    box = lambda at, starts: (np.array([at[s : s + PIECE].min(0) for s in starts]), np.array([at[s : s + PIECE].max(0) for s in starts]))
    (low_a, high_a), (low_b, high_b) = box(one @ axes, starts_a), box(two @ axes, starts_b)
    gap = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]))
    near = (gap**2).sum(2) <= epsilon**2
    a32, b32 = one.astype(np.float32), two.astype(np.float32)
    for p, s in enumerate(starts_a):
        piece = a32[s : s + PIECE]
        open_ = np.flatnonzero(near[p])
        open_ = open_[open_ >= p] if same else open_
        if not len(open_):
            continue
        first, stop = int(open_[0]) * PIECE, (int(open_[-1]) + 1) * PIECE
        products = piece @ b32[first:stop].T
        i, j = np.nonzero(products >= least - slack)
        sure = products[i, j] >= least + slack
        i, j = i + s, j + first
        if same:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        open_ = np.flatnonzero(~sure)
        for k in range(0, len(open_), NEAR):
            at = open_[k : k + NEAR]
            sure[at] = np.einsum("ij,ij->i", one[i[at]], two[j[at]]) >= least
        if sure.any():
            yield i[sure], j[sure]


def find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of each position."""
    root = parent[at]
    while (root != (above := parent[root])).any():
        root = above
    return root


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each pair of positions; a root is the least position of its tree."""
    while True:
        a, b = find(parent, i), find(parent, j)
        apart = a != b
        if not apart.any():
            return
        i, j = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _join(batches: Iterator[pa.RecordBatch], size: int, kind: np.dtype, least: float, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cls, root, links) of what is linked in a pair of blocks; links are counted and united by piece and then let go."""
    for batch in batches:
        for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
            same = a.as_py() == b.as_py()
            ids_a, n_a, one = _unpack(x.as_buffer(), size, kind)
            ids_b, n_b, two = (ids_a, n_a, one) if same else _unpack(y.as_buffer(), size, kind)
            shift = 0 if same else len(ids_a)
            ids, n = (ids_a, n_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([n_a, n_b]))
            links, parent = np.zeros(len(ids)), np.arange(len(ids))
            for i, j in link_block_pair(one, two, same, least, axes):
                j = j + shift
                links += np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
                unite(parent, i, j)
            linked = np.flatnonzero(links)
            labels = ids.copy()
            root = find(parent, np.arange(len(ids)))
            np.minimum.at(labels, root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(labels[root[linked]]), pa.array(links[linked].astype(np.int64))], ["cls", "root", "links"])


def _close(low_a: str, high_a: str, low_b: str, high_b: str, epsilon: float) -> Column:
    gaps = F.expr(f"aggregate(zip_with(zip_with({low_a}, {high_b}, (x, y) -> x - y), zip_with({low_b}, {high_a}, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)")
    return gaps <= epsilon**2 + 1e-9


def block_pairs(blocks: DataFrame, count: int, epsilon: float) -> DataFrame:
    """(a, b) with a <= b: pairs of blocks whose boxes are not provably apart, by descending the tree of intervals."""
    levels = [blocks.select(F.col("block").alias("node"), "low", "high")]
    while count > 1:
        below = levels[-1].select(F.expr(f"node div {FAN}").alias("node"), F.posexplode(F.arrays_zip("low", "high")).alias("axis", "side"))
        sides = below.groupBy("node", "axis").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        listed = sides.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("sides"))
        levels.append(cut(listed.select("node", F.col("sides.low").alias("low"), F.col("sides.high").alias("high"))))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in reversed(levels[:-1]):
        one = nodes.select(F.expr(f"node div {FAN}").alias("a"), F.col("node").alias("next_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        two = nodes.select(F.expr(f"node div {FAN}").alias("b"), F.col("node").alias("next_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        joined = pairs.join(one, "a").join(two, "b").filter("next_a <= next_b").filter(_close("low_a", "high_a", "low_b", "high_b", epsilon))
        pairs = joined.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"))
    return pairs


def _links_of_size(classes: DataFrame, size: int, least: float) -> DataFrame:
    epsilon = float(np.sqrt(2 - 2 * least))
    kind = np.dtype("<f4" if classes.schema["vector"].dataType.elementType == FloatType() else "<f8")
    rows = max(PIECE, BLOCK_BYTES // (kind.itemsize * size)) if size else 1
    sums = mapped(classes.select("vector"), partial(_moments, size=size), "slot int, sums binary").groupBy("slot").applyInArrow(_add, "slot int, sums binary").collect()
    total = sum(np.frombuffer(r["sums"], np.float64).reshape(size + 1, size) for r in sums)
    _, axes = np.linalg.eigh(total[1:])
    axes = np.ascontiguousarray(axes[:, ::-1][:, : min(LEADING, size)])
    placed = mapped(classes.select("cls", "n", "vector"), partial(_project, size=size, axes=axes, epsilon=epsilon), "cls long, n long, raw binary, cells array<int>")
    line = cut(placed.orderBy("cells", "cls").drop("cells")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(MASK))
    # A row per partition of the sorted sequence.
    sizes = sorted((r["part"], r["count"]) for r in line.groupBy("part").count().collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    if not offsets:
        return classes.sparkSession.createDataFrame([], "cls long, root long, links long")
    starts = classes.sparkSession.createDataFrame(offsets, "part int, start long")
    line = line.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("at")).withColumn("block", F.expr(f"position div {rows}"))
    blocks = cut(line.select("block", "position", "cls", "n", "raw").groupBy("block").applyInArrow(_pack(size, kind, axes), "block long, payload binary, low array<double>, high array<double>"))
    pairs = block_pairs(blocks, -(-before // rows), epsilon)
    one, two = (blocks.select(F.col("block").alias(c), F.col("payload").alias(p)) for c, p in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return mapped(both, partial(_join, size=size, kind=kind, least=least, axes=axes), "cls long, root long, links long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows link when their cosine is `least` or more. Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different sizes. n_links counts rows, so equal vectors count each other. component_id is the least
    key reached, the row's own without a link; kept says that they are equal. A null key is never the least of a component that
    has another. Other columns are ignored; an empty table gives no rows.
    """
    ready(vectors.sparkSession)
    # Single precision stays as it is stored until it is worked on: half the bytes to move.
    own = vectors.schema[vector].dataType
    single = isinstance(own, ArrayType) and own.elementType == FloatType()
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector")).withColumn("vector", F.when(linkable(F.col("vector")), F.col("vector")))
    grouped = rows.filter("vector is not null").groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    classes = cut(grouped.withColumn("cls", F.monotonically_increasing_id()))
    links = None
    for (size,) in sorted(classes.select(F.size("vector")).distinct().collect()):
        found = _links_of_size(classes.filter(F.size("vector") == size), size, least)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "cls long, root long, links long")
    links = cut(links)
    roots = components(links.filter("cls <> root"), "cls", "root").select(F.col("node").alias("cls"), "component")
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(counted, "cls", "left").join(roots, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "component").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = rows.join(known, "vector", "left")
    return done.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
