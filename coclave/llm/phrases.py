"""Collocations of two to four words, mined level by level from vertical lists of positions.

A task numbers the words of its texts one after another and holds, for each level k, the rising positions at which a frequent
phrase of k words begins, and which phrase it is. The lists of level k + 1 come from merge-joining these positions with those one
further on: a phrase of k + 1 words stands where one of k words begins and another begins on the next word. The length of a
phrase's list is its exact frequency; lengths are added up over all tasks, and only phrases that reach the least frequency
anywhere go into the next level. Which phrases do is known to tasks from a bitmap of bounded size per level; what it lets through
by chance is counted exactly like the rest and falls at the sum.

Words are 64-bit hashes in the lists, and a phrase is the bytes of its words. Should two words of a language share a hash, one of
them frequent, all is done again with another seed, so that counts are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.llm.jaccard import _is_set, bitmap
from coclave.llm.textvec import BYTE, LOWER, mix, span_hashes
from coclave.operators.number import in_order
from coclave.runtime import discard, keep, mapped, ready, small

WORD, GAP, BREAK = range(3)
#: Bytes between words, and bytes that end a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LONGEST = 4
#: Bytes of text whose lists are made at a time, a longer text on its own.
CHUNK = 1 << 22
#: Most bits of a level's bitmap, as a power of two.
MOST_BITS = 28

Maps = list[tuple[np.ndarray, int]]


def seeded(seed: int) -> np.ndarray:
    """A random number per byte value."""
    return mix(BYTE + np.uint64(seed)) | np.uint64(1) if seed else BYTE


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def phrase_key(lang: np.uint64 | np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the phrases in the rows of `words`, other ones in each language."""
    key = mix(np.full(len(words), lang) + np.uint64(words.shape[1]))
    for column in words.T:
        key = mix(key ^ column)
    return key


def positions(texts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop, hash, piece) of all words of the texts after one another; words of a piece share its number."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = KIND[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([GAP], kind)).astype(bool).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[start]
    return data, start, stop, span_hashes(data, start, stop, codes=codes), piece


def lists(hashes: np.ndarray, piece: np.ndarray, lang: np.uint64, maps: Maps) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, frequency): the rows of `phrases` are the words of those one longer than `maps` has levels, found by its levels.

    `at` are positions, rising, at which phrases of a level begin; `of` says which phrase, a row of `phrases`.
    """
    found, first, of, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    phrases, at = found[:, None], np.arange(len(hashes))
    for bits, width in maps:
        good = _is_set(bits, phrase_key(lang, phrases), width)
        at, of = at[good[of]], of[good[of]]
        # Merge the positions with themselves, one further on.
        after = np.searchsorted(at, at + 1)
        on = np.flatnonzero(np.append(at, -1)[after] == at + 1)
        if phrases.shape[1] == 1:
            on = on[piece[at[on]] == piece[at[on] + 1]]
        pairs = of[on] * len(phrases) + of[after[on]]
        at = at[on]
        _, first, of, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        longer = phrases.shape[1] + 1
        phrases = hashes[at[first][:, None] + np.arange(longer)]
    return phrases, count


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about CHUNK bytes at a time; columns lang, text."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))
        held: list[bytes] = []
        size, lang = 0, None
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (own != lang or size >= CHUNK):
                yield lang, held
                held, size = [], 0
            lang = own
            held.append(text.as_buffer().to_pybytes())
            size += len(held[-1])
        if held:
            yield lang, held


def _binary(rows: np.ndarray) -> pa.Array:
    wide = rows.shape[1] * 8
    offsets = (np.arange(len(rows) + 1) * wide).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows, "<u8").tobytes())])


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where one stands, how often) of the distinct pairs of numbers, sorted by the first alone unless it is shared."""
    order = np.argsort(one, kind="stable")
    new = np.diff(one[order], prepend=~one[order[:1]]) != 0
    other = np.diff(two[order], prepend=two[order[:1]]) != 0
    if (other & ~new).any():
        order = np.lexsort((two, one))
        new = (np.diff(one[order], prepend=~one[order[:1]]) != 0) | (np.diff(two[order], prepend=two[order[:1]]) != 0)
    start = np.flatnonzero(new)
    return order[start], np.diff(start, append=len(one))


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, word, f) of the distinct words of each chunk."""
    for lang, texts in _by_lang(batches):
        data, start, stop, hashes, _ = positions(texts, seeded(seed))
        # Words that share a hash are told apart by a second one, so that the sums can show them.
        second = span_hashes(data, start, stop, codes=seeded(seed + (1 << 20)))
        first, count = distinct(hashes, second)
        word = pa.array([data[start[k] : stop[k]].tobytes() for k in first], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), _binary(hashes[first][:, None]), word, pa.array(count, pa.int64())], ["lang", "phrase", "word", "f"])


def _longer(batches: Iterator[pa.RecordBatch], seed: int, given: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the phrases of each chunk that are one word longer than those of the last bitmap."""
    codes, maps = seeded(seed), given.value
    for lang, texts in _by_lang(batches):
        _, _, _, hashes, piece = positions(texts, codes)
        phrases, count = lists(hashes, piece, lang_hash(lang), maps)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), _binary(phrases), pa.array(count, pa.int64())], ["lang", "phrase", "f"])


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        words = np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), -1) if blobs else np.empty((0, 1), np.uint64)
        langs = batch.column(0).to_pylist()
        known = {x: lang_hash(x) for x in set(langs)}
        key = phrase_key(np.array([known[x] for x in langs], np.uint64), words)
        yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - bits)).astype(np.int64))], ["slot"])


def _map(frequent: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the phrases, sixteen bits to each up to 2**MOST_BITS bits."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, frequent.count())))))
    return bitmap(mapped(frequent.select("lang", "phrase"), partial(_slots, bits=bits), "slot long"), bits), bits


def frequencies(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30) -> tuple[DataFrame, list[DataFrame]]:
    """(words, levels): all words (lang, phrase, word, f), and per length from 1 to LONGEST the phrases (lang, phrase, f) with f >= least."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    seed = 0
    while True:
        words = keep(mapped(rows, partial(_words, seed=seed), "lang string, phrase binary, word string, f long").groupBy("lang", "phrase", "word").agg(F.sum("f").alias("f")), "words")
        shared = words.groupBy("lang", "phrase").agg(F.count("*").alias("n"), F.max("f").alias("f"), F.sum("f").alias("all")).filter((F.col("n") > 1) & (F.col("all") >= least))
        if not shared.limit(1).count():
            break
        discard(words)
        seed += 1
    levels, maps = [words.filter(F.col("f") >= least).select("lang", "phrase", "f")], []
    for _ in range(1, LONGEST):
        maps.append(_map(levels[-1]))
        given = spark.sparkContext.broadcast(maps)
        longer = mapped(rows, partial(_longer, seed=seed, given=given), "lang string, phrase binary, f long")
        levels.append(keep(longer.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases"))
    return words, levels


def part(first: int | Column, count: int | Column) -> Column:
    """The bytes of `count` words of a phrase, from its word number `first` on, counted from 0."""
    return F.substring("phrase", F.lit(first) * 8 + 1, F.lit(count) * 8)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` first collocations of each language.

    Words are lower-cased at A-Z only and stand between spaces and tabs; phrases do not cross .,;:!? and line ends. A phrase of 2 to
    LONGEST words with a >= least occurrences, overlaps included, scores floor(2000000 * a / (l + r)) at the cut into two parts
    that makes this least, the first such cut at ties; l and r are the occurrences of the parts, n all words of the language. Phrases that
    stand inside a longer one with at least `covered` percent of their occurrences go. Ranks follow score and a from above, then
    the phrase.

    Null texts are empty, null languages `und`; a language without such phrases has no rows, and neither has an empty table. Repeated
    rows count as often as they occur; other columns are ignored. Texts of any length are read whole.
    """
    words, levels = frequencies(docs, lang, text, least)
    known = levels[0].unionByName(levels[1]).unionByName(levels[2])
    long_ = levels[1].unionByName(levels[2]).unionByName(levels[3])
    size = (F.length("phrase") / 8).cast("int")
    # Sub-phrases of two words and more, with the most that a longer phrase around them occurs.
    inner = [F.when((size > n) & (F.lit(k + n) <= size), part(k, n)) for n in range(2, LONGEST) for k in range(LONGEST - n + 1)]
    around = levels[2].unionByName(levels[3]).select("lang", "f", F.explode(F.array(*inner)).alias("phrase")).filter("phrase is not null").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    held = long_.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (wide("around") * 100 < wide("f") * covered)).drop("around")
    # The frequency of each part of each cut, all by one join.
    cuts = [F.when(F.lit(k) < size, F.struct(F.lit(k).alias("k"), F.lit(side).alias("right"), (part(k, size - k) if side else part(0, k)).alias("part"))) for k in range(1, LONGEST) for side in (False, True)]
    parts = held.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*cuts)).alias("cut")).filter("cut is not null").select("lang", "phrase", "a", "cut.*")
    counted = parts.join(known.withColumnRenamed("phrase", "part"), ["lang", "part"]).groupBy("lang", "phrase", "a")
    counted = counted.agg(*(F.max(F.when((F.col("k") == k) & (F.col("right") == F.lit(side)), F.col("f"))).alias(f"{'r' if side else 'l'}{k}") for k in range(1, LONGEST) for side in (False, True)))
    each = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = counted.withColumn("cut", F.array_min(F.array(*each))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The rank by score and a, ties in any order, shows what can be among the first; only these are spelled out.
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    line = keep(in_order(scored, order, "at"), "line")
    first = small(line.groupBy("lang").agg(F.min("at").alias("first")), "first")
    last = small(line.join(first, "lang").filter(F.col("at") == F.col("first") + most - 1).select("lang", F.struct("score", "a").alias("last")), "last")
    near = line.drop("at").join(last, "lang", "left").filter(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last"))).drop("last")
    named = near.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda k: part(k, F.lit(1)))).alias("k", "one"))
    named = named.join(words.select("lang", F.col("phrase").alias("one"), "word"), ["lang", "one"]).groupBy("lang", F.col("phrase").alias("bytes"), "a", "l", "r", "score")
    named = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = in_order(named.drop("bytes"), order, "at")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    start = small(ranked.groupBy("lang").agg(F.min("at").alias("start")).join(total, "lang"), "start")
    done = ranked.join(start, "lang").withColumn("rank", F.col("at") - F.col("start") + 1).filter(F.col("rank") <= most)
    return done.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
