"""Best-fit packing planned over counts of lengths; documents then take planned slots by their rank within a length.

The plan sees at most `capacity` lengths with their counts. Sequences with equal room left are interchangeable, so best fit moves
whole stretches of sequence numbers from one amount of room to another, and the plan is a list of
(length, first rank, how many, first sequence, offset), whatever the number of documents.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coclave.llm.tokens import encoder
from coclave.runtime import keep, mapped, ready

#: Ranks of one length that share a join key.
BLOCK = 256
#: Characters encoded at a time.
CHUNK = 1 << 20


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first: (length, first rank, how many, first sequence, offset); sequences are numbered from 0."""
    rooms: dict[int, list[list[int]]] = {}  # room left: [first sequence, how many]
    active: list[int] = []  # rooms in use, sorted
    slots, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(active, length)
            if k == len(active):
                opened = -(-left // (capacity // length))
                rooms[capacity] = [[used, opened]]
                active.append(capacity)
                used += opened
            room = active[k]
            after = room - length
            while left and rooms[room]:
                first, n = rooms[room].pop()
                taken = min(n, left)
                if taken < n:
                    rooms[room].append([first + taken, n - taken])
                slots.append((length, rank, taken, first, capacity - room))
                rank, left = rank + taken, left - taken
                if after:
                    if after not in rooms:
                        rooms[after] = []
                        bisect.insort(active, after)
                    rooms[after].append([first, taken])
            if not rooms[room]:
                del rooms[room]
                active.remove(room)
    return slots


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = encoder(path)
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHUNK):
                held += len(texts[stop])
                stop += 1
            rows = []
            for k, ids in zip(keys[at:stop], words.encode(texts[at:stop]), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
            k, p, s, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"],
            )
            at = stop


def cut_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids with `end_id` behind them, cut only beyond `capacity`.

    Null and empty texts are the end id alone; null and repeated keys give pieces like any others; an empty table gives none.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return mapped(
        rows,
        partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id),
        "key long, piece int, start long, length long, ids_crc32 long",
    )


def place(pieces: DataFrame, capacity: int = 4096, spread: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset.

    Ranks within a length are counted in salted parts of about `spread` pieces, so that one frequent length is not one task. Equal
    pieces, also those with null keys, take places of their own; no pieces, no rows.
    """
    spark: SparkSession = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = plan(counts, capacity)
    schema = "length long, first long, n long, sequence long, offset long"
    table = pa.table([list(c) for c in zip(*slots, strict=True)] or [pa.array([], pa.int64())] * 5, ["length", "first", "n", "sequence", "offset"])
    planned = (
        (spark.createDataFrame(table.to_pandas(), schema) if slots else spark.createDataFrame([], schema))
        .withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + n - 1) div {BLOCK}"))))
    )
    # One row per length: `capacity` rows at most.
    parts = spark.createDataFrame([(k, -(-n // spread)) for k, n in counts.items()], "length long, parts long")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    base = (
        salted.groupBy("length", "part")
        .agg(F.count("*").alias("size"))
        .withColumn("base", F.coalesce(F.sum("size").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("length", "part", "base")
    )
    within = Window.partitionBy("length", "part").orderBy("key", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("at", F.row_number().over(within) - 1)
        .join(base, ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("at"))
        .withColumn("block", F.expr(f"rank div {BLOCK}"))
    )
    return (
        ranked.join(planned, ["length", "block"])
        .filter("rank >= first and rank < first + n")
        .select("key", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    )


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Null and empty texts are the end id alone. Null keys and repeated rows are packed like any others. Only documents of more
    than `capacity` ids are cut. Sequences are gapless from offset 0. An empty table gives no rows.
    """
    return place(keep(cut_pieces(docs, tokenizer, key, text, capacity, end_id), "pieces"), capacity).withColumnRenamed("key", key)
