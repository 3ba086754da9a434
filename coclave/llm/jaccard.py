"""Near-duplicate classes of whole texts by the Jaccard similarity of their word shingles, exact at the threshold.

A size-aware join. Every set is ordered by (level, hash), the level being the order of magnitude of the number of documents that
have a shingle, read from bitmaps of fixed size. Two sets of similarity t share their first common shingle inside the first
|A| - ceil(t|A|) + 1 of each, and any two of their first |A| - ceil(t|A|) + 2. Small sets emit all two-element subsets of the
longer prefix, large ones the shingles of the shorter one as entries of inverted lists, and so do small sets that a large one can
reach. The size between small and large has the least estimated cost, from the corpus's sizes and list lengths.

Lists of rare keys are short by construction (at most FREQUENT documents) and give all their pairs within the size and position
bounds. Lists of frequent keys are never paired off as they are: first each document is held against one representative; only
documents that this leaves in different components are paired, the smaller part of a list against the whole. An entry's position
bounds the sizes that its partners can have, so entries meet by bands of sizes, and those that no size suits meet nothing.

A candidate is first held against parity sketches: a set's sketch has the parity of the number of its shingles in each of 2 to 4
bits a shingle, so bits that differ between two sketches are never more than shingles that differ. Entries of frequent keys carry
a short sketch of SHORT bits too, so of texts that are put together from common sentences only pairs that it does not rule out are
made at all (sets beyond some 900 shingles fill it, and theirs are ruled out by the long one only). Pairs that both leave
are verified on the whole sets, made again from the texts. Links inside a component already found are not looked for, as they
cannot change the classes.

Equal sets are one class from the start; only classes are compared. A class is a 64-bit hash of its set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coclave.llm.textvec import mix, shingle_sets
from coclave.operators.components import components
from coclave.runtime import cut, discard, keep, mapped, ready, release

#: Documents beyond which a shingle counts as frequent, and the factor from there to each further level.
FREQUENT, STEP, LEVELS = 32, 8, 5
#: Bits below the bucket's that tell counted shingles apart.
SLOT_BITS = 24
#: Bytes of text whose sets are made at a time, and hashes that a task holds before it writes them out.
CHUNK, HELD = 1 << 20, 1 << 20
#: Bits of one fragment of a bitmap.
FRAGMENT = 1 << 16
ENTRY = np.dtype([("key", "<u8"), ("cls", "<u8"), ("size", "<u4"), ("pos", "<u2"), ("loc", "<u2")])
SUBSET = 65535  # the position of entries that are subsets
#: Bits of the sketches that entries of frequent keys carry.
SHORT = 512
#: Classes that a task remembers to have sent.
SEEN = 1 << 16


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set that does not depend on order."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes whose similarity reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int, common: int) -> int:
    return min(n, n - -(-percent * n // 100) + common)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, shingles) of each row, in chunks of bounded text."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        held: list[bytes] = []
        size, first = 0, 0
        for k, t in enumerate(batch.column(1)):
            raw = b"" if not t.is_valid else t.as_buffer().to_pybytes()
            held.append(raw)
            size += len(raw)
            if size >= CHUNK or k + 1 == len(keys):
                yield from zip(keys[first : k + 1], shingle_sets(held, width), strict=True)
                held, size, first = [], 0, k + 1


def sketch_of(shingles: np.ndarray, cells: int = 0) -> bytes:
    """The parities of how many shingles fall into each of a power of two of cells, if not given at least two for each shingle."""
    cells = cells or max(64, 1 << (2 * len(shingles) - 1).bit_length())
    fallen = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((fallen & 1).astype(np.uint8)).tobytes()


def differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bits in which rows of sketches differ, the larger ones folded to the size of the smaller ones: a bound from below on the
    number of shingles that are in one set only."""
    while one.shape[1] > two.shape[1]:
        one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
    while two.shape[1] > one.shape[1]:
        two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
    return np.bitwise_count(one ^ two).sum(1, dtype=np.int64)


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches do not rule them out; columns a, b, sizes of both, sketches of both."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        most = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
        good = np.zeros(len(na), bool)
        shape = np.array([len(u) << 32 | len(v) for u, v in zip(x, y, strict=True)], np.int64)
        for kind in np.unique(shape):
            at = np.flatnonzero(shape == kind)
            one, two = (np.frombuffer(b"".join([z[k] for k in at]), np.uint8).reshape(len(at), -1) for z in (x, y))
            good[at] = differing(one, two) <= most[at]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, len(s), *((class_of(s), sketch_of(s), np.frombuffer(sketch_of(s, SHORT), "<i8")) if len(s) else (None, None, None))) for k, s in _sets(iter([batch]), width)]
        k, n, c, d, e = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), pa.array(e, pa.list_(pa.int64()))], ["key", "n_shingles", "cls", "sketch", "short"])


def _blobs(buckets: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """One row per run of equal bucket numbers, with what pack(from, to) writes."""
    edge = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    stop = np.append(edge[1:], len(buckets))
    return pa.RecordBatch.from_arrays([pa.array(buckets[edge].astype(np.int32)), pa.array([pack(a, b) for a, b in zip(edge, stop, strict=True)], pa.binary())], ["bucket", "blob"])


def _count(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct slots of many shingles by bucket, sorted, as differences of two or four bytes; before them how many have more
    than one document, which of them, and how many documents these have."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        slots, often = np.unique(np.concatenate(parts) >> np.uint64(64 - bits - SLOT_BITS), return_counts=True)
        slots = slots.astype(np.int64)

        def pack(a: int, b: int) -> bytes:
            steps = np.diff(slots[a:b], prepend=(slots[a] >> SLOT_BITS) << SLOT_BITS)
            small = int(steps.max()) < 65536
            more = np.flatnonzero(often[a:b] > 1)
            head = np.concatenate(([len(more)], more, often[a:b][more])).astype("<u4").tobytes()
            return bytes([small]) + head + steps.astype("<u2" if small else "<u4").tobytes()

        return _blobs(slots >> SLOT_BITS, pack)

    parts, held = [], 0
    for _, s in _sets(batches, width):
        if len(s):
            parts.append(s)
            held += len(s)
            if held >= HELD:
                yield flush(parts)
                parts, held = [], 0
    if parts:
        yield flush(parts)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots within the bucket, documents of each) of what _count() packed."""
    more = int.from_bytes(blob[1:5], "little")
    head = np.frombuffer(blob, "<u4", 2 * more, offset=5)
    slots = np.cumsum(np.frombuffer(blob, "<u2" if blob[0] else "<u4", offset=5 + 8 * more), dtype=np.int64)
    often = np.ones(len(slots), np.int64)
    often[head[:more]] = head[more:]
    return slots, often


def _frequent(table: pa.Table, most: int) -> pa.Table:
    """Of one bucket: the frequent slots with their level from 1, and a row with the sums that the cost needs."""
    bucket = table.column("bucket")[0].as_py()
    slots, often = (np.concatenate(x) for x in zip(*(unpack_counts(b.as_py()) for b in table.column("blob")), strict=True))
    order = np.argsort(slots, kind="stable")
    slots, often = slots[order], often[order]
    first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    slot, n = slots[first], np.add.reduceat(often, first)
    many = n > most
    rare = n[~many].astype(np.float64)
    level = 1 + sum((n[many] > most * STEP**k).astype(np.int32) for k in range(1, LEVELS))
    slot, k = (slot[many] + (bucket << SLOT_BITS)).tolist(), int(many.sum())
    return pa.table(
        {"slot": pa.array([*slot, None], pa.int64()), "level": pa.array([*np.broadcast_to(level, k).tolist(), None], pa.int32()), "n": [0.0] * k + [float(rare.sum())], "squares": [0.0] * k + [float((rare**2).sum())]}
    )


def _per_bucket(work: Callable[..., pa.Table], **given: int) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow reads the kind of its function from the hints."""

    def apply(table: pa.Table) -> pa.Table:
        return work(table, **given)

    return apply


def _fragment(table: pa.Table) -> pa.Table:
    bits = np.zeros(FRAGMENT, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    return pa.table({"fragment": table.column("fragment")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap of 2**bits bits with the bits in `slot` set; its size does not depend on the number of rows."""
    placed = slots.select(F.expr(f"slot div {FRAGMENT}").alias("fragment"), (F.col("slot") % FRAGMENT).alias("bit")).distinct()
    out = np.zeros(max(1, (1 << bits) // FRAGMENT) * FRAGMENT // 8, np.uint8)
    for row in placed.groupBy("fragment").applyInArrow(_fragment, "fragment long, bits binary").collect():
        at = row["fragment"] * FRAGMENT // 8
        out[at : at + FRAGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _is_set(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - width)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def levels_of(hashes: np.ndarray, maps: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """How many of the bitmaps, each of the slots of a level and beyond, hold each hash; one that a map lacks is in no later one."""
    level = np.zeros(len(hashes), np.uint8)
    for k, (bits, width) in enumerate(maps):
        at = np.flatnonzero(level == k)
        if not len(at):
            break
        level[at] += _is_set(bits, hashes[at], width)
    return level


def _entries(batches: Iterator[pa.RecordBatch], width: int, percent: int, small: int, bits: int, frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Entries by bucket of their key; those of frequent keys by numbers below 0, spread at random over as many."""

    def flush(parts: list[np.ndarray], often: list[np.ndarray]) -> pa.RecordBatch:
        rows, many = np.concatenate(parts), np.concatenate(often)
        buckets = (rows["key"] >> np.uint64(64 - bits)).astype(np.int64)
        salted = -1 - (mix(rows["key"] ^ rows["cls"]) >> np.uint64(64 - bits)).astype(np.int64)
        buckets = np.where(many, salted, buckets)
        order = np.argsort(buckets, kind="stable")
        rows = rows[order]
        return _blobs(buckets[order], lambda a, b: rows[a:b].tobytes())

    seen: set[int] = set()
    parts, often, held = [], [], 0
    maps = frequent.value
    for _, s in _sets(batches, width):
        if not len(s) or (cls := class_of(s)) in seen:
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(cls)
        n = len(s)
        level = levels_of(s, maps)
        order = np.argsort(level, kind="stable")
        line, flags = s[order], level[order] > 0
        # Eight bits of a minimum hash, which similar sets often share, and the share of frequent shingles.
        loc = (int((s * np.uint64(0xC2B2AE3D27D4EB4F)).min() >> np.uint64(47)) & 0xFF) << 8 | round(255 * float(flags.mean()))
        new = []
        if n > small or 100 * n >= percent * (small + 1):
            k = prefix(n, percent, 1)
            e = np.zeros(k, ENTRY)
            e["key"], e["pos"] = line[:k], np.minimum(np.arange(k), SUBSET - 1)
            new.append((e, flags[:k]))
        if n <= small and n > 1:
            k = prefix(n, percent, 2)
            i, j = np.triu_indices(k, 1)
            e = np.zeros(len(i), ENTRY)
            e["key"], e["pos"] = mix(line[i] * np.uint64(0x9E3779B97F4A7C15) ^ line[j]), SUBSET
            new.append((e, flags[i] & flags[j]))
        for e, f in new:
            e["cls"], e["size"], e["loc"] = np.uint64(cls & (2**64 - 1)), n, loc
            parts.append(e)
            often.append(f)
            held += len(e)
        if held >= HELD // 4:
            yield flush(parts, often)
            parts, often, held = [], [], 0
    if parts:
        yield flush(parts, often)


FOUND = "key long, a long, b long, size int, pos int, loc int, lists int"


def _pairs(table: pa.Table, percent: int, small: int) -> pa.Table:
    """Of a bucket of rare keys: distinct candidate pairs (a < b) with in how many lists; of frequent keys: the entries."""
    rows = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("blob").to_pylist()])
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"key": rows["key"].copy().view(np.int64), "a": rows["cls"].copy().view(np.int64), "b": pa.nulls(len(rows), pa.int64()), "size": rows["size"].astype(np.int32), "pos": rows["pos"].astype(np.int32), "loc": rows["loc"].astype(np.int32), "lists": pa.nulls(len(rows), pa.int32())})
    rows = rows[np.lexsort((rows["cls"], rows["key"]))]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1])
    rows = rows[~same]
    left, right = [], []
    step = 1
    at = np.arange(len(rows))
    while len(at):  # pairs at distance `step` within a list
        at = at[at + step < len(rows)]
        at = at[rows["key"][at] == rows["key"][at + step]]
        left.append(at)
        right.append(at + step)
        step += 1
    i, j = np.concatenate(left), np.concatenate(right)
    x, y = rows[i], rows[j]
    good = _possible(x["size"].astype(np.int64), y["size"].astype(np.int64), x["pos"].astype(np.int64), y["pos"].astype(np.int64), percent, small)
    a, b = x["cls"][good].view(np.int64), y["cls"][good].view(np.int64)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    edge = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(low) else np.zeros(0, np.int64)
    n = len(edge)
    return pa.table({"key": pa.nulls(n, pa.int64()), "a": low[edge], "b": high[edge], "size": pa.nulls(n, pa.int32()), "pos": pa.nulls(n, pa.int32()), "loc": pa.nulls(n, pa.int32()), "lists": np.diff(np.append(edge, len(low))).astype(np.int32)})


def _possible(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int, small: int) -> np.ndarray:
    """Whether a pair at these positions of a common key can be similar, taking the key for its first common one."""
    subset = pa_ == SUBSET
    least = -(-percent * (na + nb) // (100 + percent))
    sized = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    placed = 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least
    both_small = (na <= small) & (nb <= small)
    return sized & np.where(subset, True, placed & ~both_small)


def _whole_texts(batches: Iterator[pa.RecordBatch], width: int, wanted: Broadcast, map_bits: int) -> Iterator[pa.RecordBatch]:
    """(cls, text) of the classes that are wanted, and of some that are not; repeats of one task are mostly left out."""
    seen: set[int] = set()
    marked = wanted.value
    for batch in batches:
        classes, rows = [], []
        for k, (_, s) in enumerate(_sets(iter([batch]), width)):
            if len(s) and (cls := class_of(s)) not in seen and _is_set(marked, mix(np.array([cls], np.int64).view(np.uint64)), map_bits)[0]:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                classes.append(cls)
                rows.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), batch.column(1).take(pa.array(rows, pa.int64()))], ["cls", "text"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that reach the threshold; columns a, b, a text of each."""
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        good: list[bool] = []
        while len(good) < len(pairs):
            held: dict[int, bytes] = {}
            size, stop = 0, len(good)
            while stop < len(pairs) and size < CHUNK:
                for cls, texts in zip(pairs[stop], batch.columns[2:], strict=True):
                    if cls not in held:
                        held[cls] = texts[stop].as_buffer().to_pybytes()
                        size += len(held[cls])
                stop += 1
            sets = dict(zip(held, shingle_sets(list(held.values()), width), strict=True))
            for a, b in pairs[len(good) : stop]:
                x, y = sorted((sets[a], sets[b]), key=len)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _mark_slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int64))], ["slot"])


def _by_mark(batches: Iterator[pa.RecordBatch], column: int, marks: Broadcast, bits: int, marked: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(column)
        found = _is_set(marks.value, mix(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), bits)
        found &= keys.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(found if marked else ~found, pa.bool_()))


def marks_of(marked: DataFrame, key: str) -> tuple[Broadcast, int]:
    """A bitmap of bounded size of the keys, by which rows can be told apart without dealing out whole texts."""
    bits = min(27, max(16, math.ceil(math.log2(16 * max(1, marked.count())))))
    keys = marked.select(F.col(key).cast("long"))
    return marked.sparkSession.sparkContext.broadcast(bitmap(mapped(keys, partial(_mark_slots, bits=bits), "slot long"), bits)), bits


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in `gone` (one column of distinct keys); rows with a null key stay."""
    marks, bits = marks_of(gone, key)
    clear, others = (mapped(docs, partial(_by_mark, column=docs.columns.index(key), marks=marks, bits=bits, marked=found), docs.schema) for found in (False, True))
    return clear.unionByName(others.join(gone, key, "left_anti").select(*docs.columns))


def _add_class(batches: Iterator[pa.RecordBatch], column: int, width: int, key: int, marks: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows with a marked key and the class of their text."""
    for batch in _by_mark(batches, key, marks, bits, True):
        texts = batch.column(column).cast(pa.binary())
        sets = _sets(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], ["key", "text"])]), width)
        classes = pa.array([class_of(s) if len(s) else None for _, s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, classes], [*batch.schema.names, "__cls"])


def least_of_groups(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs without those that link with a row of a lesser key; `groups` are the rows of grouped().

    Rows that share a key go by their own texts: of those that link the one with the longest text stays, at a tie the last in
    order. Rows with a null key or without words stay. Only rows whose key may have to go are signed again and joined. All columns
    of docs stay as they are, whatever their names; an empty table gives no rows.
    """
    linked = groups.filter(F.col(key).isNotNull() & (F.col("n_shingles") > 0)).select(F.col(key).alias("__key"), F.col("cls").alias("__cls"), F.col("component").alias("__component"), "component_id")
    own = linked.filter("__key = component_id")
    often = own.groupBy("__key", "__component").count().filter("count > 1").drop("count")
    again = own.join(often, ["__key", "__component"], "left_semi").withColumn("__gone", F.lit(False))
    gone = linked.filter("__key <> component_id").withColumn("__gone", F.lit(True))
    marked = cut(gone.unionByName(again).drop("component_id").distinct())
    marks, bits = marks_of(marked.select("__key").distinct(), "__key")
    at, schema = docs.columns.index(key), StructType([*docs.schema.fields, StructField("__cls", LongType())])
    clear = mapped(docs, partial(_by_mark, column=at, marks=marks, bits=bits, marked=False), docs.schema)
    signed = mapped(docs, partial(_add_class, column=docs.columns.index(text), width=width, key=at, marks=marks, bits=bits), schema).withColumn("__key", F.col(key).cast("long"))
    kept = clear.unionByName(signed.join(marked, ["__key", "__cls"], "left_anti").select(*docs.columns))
    if not (repeated := marked.filter("not __gone")).limit(1).count():
        return kept
    whole = F.struct(F.length(text).alias("length"), F.col(text).alias("last"), F.struct(*docs.columns).alias("row"))
    best = signed.join(repeated, ["__key", "__cls"]).groupBy("__key", "__component").agg(F.max(whole).alias("best"))
    return kept.unionByName(best.select("best.row.*"))


def size_band(size: Column) -> Column:
    """Sizes up to 64 as they are, then in 16 steps to each doubling."""
    return F.when(size <= 64, size).otherwise(64 + F.floor(F.log2(size / 64) * 16)).cast("int")


class Join:
    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.spark, self.width, self.percent = ready(docs.sparkSession), width, percent
        self.rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary").alias("text"))
        self.signed = keep(mapped(self.rows, partial(_sign, width=width), "key long, n_shingles long, cls long, sketch binary, short array<long>"), "signed")
        classes = self.signed.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("least"), F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch"), F.min("short").alias("short"))
        self.classes = keep(classes, "classes")

    def boundary(self, sizes: list[tuple[int, int]], scanned: float) -> int:
        """The size at which enumerating subsets and lists cost least, for (size, how many) and documents scanned per entry.

        All sizes up to 64 are tried, and beyond it those in `sizes`. As lists of rare keys have FREQUENT documents at most, subsets
        cost more from about 270 shingles on, so the boundary is below that whatever the corpus.
        """
        best, at = math.inf, 0
        for x in [*range(65), *sorted(s for s, _ in sizes if s > 64)]:
            pairs = sum(n * math.comb(prefix(s, self.percent, 2), 2) for s, n in sizes if s <= x)
            lists = sum(n * prefix(s, self.percent, 1) * (1 + scanned) for s, n in sizes if 100 * s >= self.percent * (x + 1))
            if pairs + lists < best:
                best, at = pairs + lists, x
        return at

    def candidates(self) -> DataFrame:
        """FOUND rows: candidate pairs of rare keys, entries of frequent ones."""
        # Sizes above 64 in steps of a sixteenth of their power of two: a table of bounded length.
        size = F.when(F.col("size") <= 64, F.col("size")).otherwise(F.floor(F.pow(2.0, F.floor(F.log2("size") * 16) / 16)).cast("long"))
        sizes = [(r["at"], r["n"]) for r in self.classes.groupBy(size.alias("at")).agg(F.count("*").alias("n")).collect()]
        total = self.signed.agg(F.sum("n_shingles")).first()[0] or 0
        bits = min(24, max(4, math.ceil(math.log2(max(total, 1) / (1 << 19) + 1))))
        map_bits = min(30, max(16, math.ceil(math.log2(max(total, 8) / 8))), bits + SLOT_BITS)
        counted = mapped(self.rows, partial(_count, width=self.width, bits=bits), "bucket int, blob binary")
        slots = cut(counted.groupBy("bucket").applyInArrow(_per_bucket(_frequent, most=FREQUENT), "slot long, level int, n double, squares double"))
        seen, squares = slots.agg(F.sum("n"), F.sum("squares")).first()
        # Each level has an eighth of the slots of the one before at most, and so a smaller map.
        maps = []
        for level in range(1, (slots.agg(F.max("level")).first()[0] or 0) + 1):
            own = max(16, map_bits - (level - 1) * (STEP.bit_length() - 1))
            maps.append((bitmap(slots.filter(F.col("level") >= level).select(F.shiftrightunsigned("slot", bits + SLOT_BITS - own).alias("slot")), own), own))
        small = self.boundary(sizes, squares / seen if seen else 1.0)
        given = self.spark.sparkContext.broadcast(maps)
        entries = mapped(self.rows, partial(_entries, width=self.width, percent=self.percent, small=small, bits=bits, frequent=given), "bucket int, blob binary")
        self.small = small
        found = keep(entries.groupBy("bucket").applyInArrow(_per_bucket(_pairs, percent=self.percent, small=small), FOUND), "candidates")
        given.destroy()
        release(self.spark)
        return found

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that the sketches do not rule out."""
        one, two = (self.classes.select(F.col("cls").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
        return mapped(joined, partial(_plausible, percent=self.percent), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that reach the threshold on their whole sets."""
        pairs = cut(self.plausible(pairs))
        if not (n := pairs.count()):
            return pairs
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        bits = min(27, max(16, math.ceil(math.log2(16 * n))))
        wanted = self.spark.sparkContext.broadcast(bitmap(mapped(ends, partial(_mark_slots, bits=bits), "slot long"), bits))
        texts = mapped(self.rows, partial(_whole_texts, width=self.width, wanted=wanted, map_bits=bits), "cls long, text binary").groupBy("cls").agg(F.first("text").alias("text"))
        one = texts.select(F.col("cls").alias("a"), F.col("text").alias("x"))
        two = texts.select(F.col("cls").alias("b"), F.col("text").alias("y"))
        joined = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
        done = cut(mapped(joined, partial(_verify, percent=self.percent, width=self.width), "a long, b long"))
        # All stages that read it have ended: with pairs on one side, none is dropped as not needed.
        wanted.destroy()
        release(self.spark)
        return done

    def crossed(self, entries: DataFrame) -> DataFrame:
        """Pairs (a, b) of the entries (key, cls, size, pos, short, label, main) of a key that have different labels and can be similar.

        What an entry's position leaves bounds the size of a partner from above, the threshold from below. The larger of two goes
        to the bands of sizes that it allows, the smaller to its own, if it allows a larger one at all; `main` marks the label
        with most entries of the key, whose entries do not meet each other.
        """
        size, after = F.col("size"), F.col("size") - F.col("pos")
        placed = F.floor(F.lit(100 + self.percent) * after / F.lit(self.percent)) - size
        most = F.least(F.floor(100 * size / F.lit(self.percent)), F.when(F.col("pos") == SUBSET, F.lit(1 << 40)).otherwise(placed))
        bound = entries.withColumn("most", most).withColumn("least", F.ceil(F.lit(self.percent) * size / 100))
        large = bound.filter("least(size, most) >= least").withColumn("band", F.explode(F.sequence(size_band(F.col("least")), size_band(F.least("size", "most")))))
        large = large.select("key", "band", F.col("cls").alias("xa"), F.col("size").alias("xs"), F.col("most").alias("xm"), F.col("pos").alias("xp"), F.col("label").alias("xl"), F.col("main").alias("x_main"), F.col("short").alias("x_short"))
        small = bound.filter("most >= size").withColumn("band", size_band(size))
        small = small.select("key", "band", F.col("cls").alias("ya"), F.col("size").alias("ys"), F.col("most").alias("ym"), F.col("pos").alias("yp"), F.col("label").alias("yl"), F.col("main").alias("y_main"), F.col("short").alias("y_short"))
        fits = (F.col("xl") != F.col("yl")) & ((F.col("ys") < F.col("xs")) | ((F.col("ys") == F.col("xs")) & (F.col("ya") < F.col("xa")))) & (F.col("xm") >= F.col("ys")) & (F.col("ym") >= F.col("xs")) & (100 * F.col("ys") >= F.lit(self.percent) * F.col("xs"))
        # Two small sets meet by subsets alone.
        fits &= (F.col("xp") == SUBSET) | (F.col("xs") > self.small)
        # What the short sketches rule out is not written.
        differ = sum((F.bit_count(F.col("x_short")[k].bitwiseXOR(F.col("y_short")[k])) for k in range(SHORT // 64)), F.lit(0))
        both = F.col("xs") + F.col("ys")
        fits &= differ <= both - 2 * F.ceil(F.lit(self.percent) * both / F.lit(100 + self.percent))
        pairs = large.filter("not x_main").join(small, ["key", "band"]).filter(fits).select("xa", "ya")
        pairs = pairs.unionByName(large.filter("x_main").join(small.filter("not y_main"), ["key", "band"]).filter(fits).select("xa", "ya"))
        return pairs.select(F.least("xa", "ya").alias("a"), F.greatest("xa", "ya").alias("b")).distinct()

    def links(self) -> DataFrame:
        """Pairs of classes that reach the threshold, enough of them to connect all that any such pairs connect."""
        found = self.candidates()
        rare = found.filter("b is not null").groupBy("a", "b").agg(F.sum("lists").alias("lists"))
        often = found.filter("b is null").select("key", F.col("a").alias("cls"), "size", "pos", F.expr("loc div 256").alias("loc"), F.expr("loc % 256").alias("share")).distinct()
        sized = lambda x, y: 100 * F.least(x, y) >= self.percent * F.greatest(x, y)
        # One partner for each class: of rare keys the one with most lists in common, of frequent ones a representative of its
        # list and minimum, or of the list. A representative is the class with most of its shingles frequent: the text that the
        # others are copies of, to which they are more alike than to each other.
        ends = rare.select(F.col("a").alias("cls"), F.col("b").alias("other"), "lists").unionByName(rare.select(F.col("b").alias("cls"), F.col("a").alias("other"), "lists"))
        first = ends.groupBy("cls").agg(F.max(F.struct("lists", "other"))["other"].alias("other"))
        hubs = often.groupBy("key", "loc").agg(F.max(F.struct("share", "cls", "size")).alias("hub"))
        heads = hubs.groupBy("key").agg(F.max("hub").alias("head"))
        near = often.join(hubs, ["key", "loc"]).filter(sized(F.col("size"), F.col("hub.size"))).select("cls", F.col("hub.cls").alias("other"))
        far = often.join(heads, "key").filter(sized(F.col("size"), F.col("head.size"))).select("cls", F.col("head.cls").alias("other"))
        most = near.unionByName(far).filter("cls <> other").groupBy("cls", "other").agg(F.count("*").alias("lists"))
        second = most.groupBy("cls").agg(F.max(F.struct("lists", "other"))["other"].alias("other"))
        probes = first.unionByName(second).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
        # Cut, as what follows reads them several times: plans of some dozen joins less, which the driver need not hold.
        probes = cut(probes)
        probed = self.verified(probes)
        label = cut(components(probed, "a", "b"))
        release(self.spark)

        def apart(pairs: DataFrame) -> DataFrame:
            one, two = (label.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")) for x in ("a", "b"))
            both = pairs.join(one, "a", "left").join(two, "b", "left")
            return both.filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")

        named = often.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
        parts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("major")).filter("labels > 1").drop("labels")
        open_ = named.join(mixed, "key").join(self.classes.select("cls", "short"), "cls").select("key", "cls", "size", "pos", "short", "label", (F.col("label") == F.col("major")).alias("main"))
        open_ = cut(open_)
        release(self.spark)
        late = apart(rare.select("a", "b")).unionByName(self.crossed(open_)).distinct()
        done = cut(probed.unionByName(self.verified(late.join(probes, ["a", "b"], "left_anti"))))
        discard(found)
        return done


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """near_duplicates() with the class of each row's text and the component of that class, which no two groups share."""
    join = Join(docs, key, text, width, percent)
    links = join.links()
    release(join.spark)
    found = components(links, "a", "b").select(F.col("node").alias("cls"), "component")
    release(join.spark)
    classes = join.classes.select("cls", "least").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    roots = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = classes.join(roots, "component").select("cls", "component", "component_id")
    done = join.signed.join(ids, "cls", "left")
    return done.select(F.col("key").alias(key), "n_shingles", "cls", "component", F.coalesce("component_id", "key").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    Rows link when 100 times the common shingles are `percent` times the united ones or more. component_id is the least key that
    a row reaches by links, itself included. A text of fewer words than `width` is one shingle; null, empty and wordless texts
    have none and link with nothing. Repeated rows link by their texts like any others; a null key is never the least of a
    component that has another. Other columns are ignored; an empty table gives no rows.
    """
    return grouped(docs, key, text, width, percent).select(key, "n_shingles", "component_id")
