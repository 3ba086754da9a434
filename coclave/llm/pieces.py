"""SentencePiece encoding and decoding by vectorised merge rounds, with the ids that the library gives.

A normalised text is cut wherever two neighbouring characters stand beside each other in no piece of the vocabulary: no merge can
cross such a place. The distinct words of a batch lie as one flat array of symbols. A round finds the best pair rank of each word
and makes that word's merges of this rank from left to right, all words and places at once; then the array is compacted, and words
without a pair leave it. Where a merge makes a new pair that ranks as high as the one just made, the word's later merges wait for
the next round, so that the order is that of one merge at a time. Words in which this goes on for PATIENCE rounds (long runs of
spaces, whose pieces all rank alike) are finished one merge at a time from a heap of pairs.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from coclave.llm.textvec import mix, span_hashes
from coclave.runtime import mapped, ready

#: The sign for a space, and from the model format the kinds of pieces and of models.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
CHARS = 0x110000
NEVER = np.iinfo(np.int32).max
#: Characters of text that are encoded at a time, a longer text on its own; distinct words that a worker remembers.
CHUNK, WORDS = 1 << 20, 1 << 18
#: Rounds in which merges may wait before the words that hold them up leave the rounds.
PATIENCE = 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; values of fixed width and of varying length as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            at += size
            yield tag >> 3, data[at - size : at]


class Vocabulary:
    """The pieces of a model, which symbols of them merge into which, and at what rank."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        pieces, kinds, scores, trained, normal = [], [], [], {}, {}
        for number, value in fields(self.library.serialized_model_proto()):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trained = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trained.get(3) != BPE or not trained.get(35) or trained.get(24) or not normal.get(3, 1) or normal.get(4, 1) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a byte-fallback BPE model with a leading space that keeps white space is needed, without symbols of the user")
        self.pieces = len(pieces)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        symbol = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        # Characters that occur in pieces but are none get numbers beyond the pieces.
        self.spare = sorted({c for p in symbol for c in p} - set(symbol))
        symbol |= {c: self.pieces + k for k, c in enumerate(self.spare)}
        self.total = len(pieces) + len(self.spare)
        self.char = np.full(CHARS, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        place = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        merges = [(symbol[p[:k]] * self.total + symbol[p[k:]], i, place[scores[i]]) for p, i in symbol.items() if i < self.pieces for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        key, made, rank = (np.array(x, np.int64) for x in zip(*sorted(merges), strict=True))
        self.best_of = {k: (r, i) for k, i, r in merges}
        self.key, self.made, self.rank = np.append(key, np.iinfo(np.int64).max), np.append(made, 0).astype(np.int32), np.append(rank, NEVER).astype(np.int32)
        # Which characters stand beside each other in a piece; class 0 stands beside none.
        beside = {(a, b) for p in symbol for a, b in zip(p, p[1:], strict=False)}
        self.kind = np.zeros(CHARS, np.uint16)
        inside = sorted({ord(c) for pair in beside for c in pair})
        self.kind[inside] = np.arange(1, len(inside) + 1)
        self.kinds = len(inside) + 1
        self.joined = np.zeros(self.kinds * self.kinds, bool)
        for a, b in beside:
            self.joined[int(self.kind[ord(a)]) * self.kinds + int(self.kind[ord(b)])] = True
        self.code = mix(np.arange(1, CHARS + 1, dtype=np.uint64)) | np.uint64(1)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else None for p, k in zip(pieces, kinds, strict=True)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NEVER where there is no merge."""
        key = left.astype(np.int64) * self.total + right
        at = np.searchsorted(self.key, key)
        good = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NEVER), self.made[at]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """What merge() makes of one word: the pair of the best rank first, of several the leftmost."""
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if symbols[a] >= 0 and b >= 0 and symbols[b] >= 0 and (found := self.best_of.get(symbols[a] * self.total + symbols[b])):
                heapq.heappush(heap, (found[0], a, symbols[a], symbols[b], found[1]))

        for a in range(len(symbols) - 1):
            offer(a)
        gone = -2 * CHARS  # no symbol
        while heap:
            _, a, x, y, made = heapq.heappop(heap)
            b = after[a]
            if symbols[a] != x or b < 0 or symbols[b] != y:
                continue
            symbols[a], symbols[b], after[a] = made, gone, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s in symbols if s != gone]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that stay of words, and the word of each; `word` numbers the word of each symbol, rising."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at these places."""
            after = np.minimum(at + 1, len(symbols) - 1)
            rank, _ = self.pair(symbols[at], symbols[after])
            return np.where((after > at) & (word[after] == word[at]), rank, NEVER)

        rank, waited = ranked(np.arange(len(symbols))), 0
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            if (over := best == NEVER).any():
                gone = np.repeat(over, sizes)
                done.append((symbols[gone], word[gone]))
                symbols, word, rank, best, sizes = symbols[~gone], word[~gone], rank[~gone], best[~over], sizes[~over]
                if not len(symbols):
                    break
            level = np.repeat(best, sizes)
            # Of merges that overlap, the first, the third and so on of each run.
            at = np.flatnonzero(rank == level)
            opens = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(at - at[run]) % 2 == 0]
            _, made = self.pair(symbols[at], symbols[at + 1])
            # The pairs that a merge makes while those on its left are made and those on its right are not.
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
            beside = symbols[left]
            close = np.flatnonzero(np.diff(at) == 2) + 1
            beside[close] = made[close - 1]
            before, _ = self.pair(beside, made)
            behind, _ = self.pair(made, symbols[right])
            before[(word[left] != word[at]) | (at == 0)] = NEVER
            behind[(word[right] != word[at]) | (right < at + 2)] = NEVER
            halts = np.minimum(before, behind) <= level[at]
            if halts.any():
                waited += 1
                if waited > PATIENCE:
                    slow = np.isin(word, word[at[halts]])
                    for w in np.unique(word[slow]):
                        left_over = self.one_by_one(symbols[word == w].tolist())
                        done.append((np.array(left_over, symbols.dtype), np.full(len(left_over), w, word.dtype)))
                    symbols, word, rank, waited = symbols[~slow], word[~slow], rank[~slow], 0
                    continue
                upto = np.cumsum(halts) - halts
                begin = np.concatenate(([True], word[at][1:] != word[at][:-1]))
                go = upto == np.maximum.accumulate(np.where(begin, upto, 0))
                at, made = at[go], made[go]
            symbols[at] = made
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, word, rank = symbols[stays], word[stays], rank[stays]
            new = at - np.arange(len(at))
            new = np.unique(np.concatenate((new, np.maximum(new - 1, 0))))
            rank[new] = ranked(new)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]


class PieceEncoder:
    """Keeps the ids of distinct words between calls; beyond `most` of them it starts anew. Words are told apart by 64-bit hashes."""

    def __init__(self, path: str, most: int = WORDS):
        self.vocabulary, self.most = Vocabulary(path), most
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.place = np.empty((0, 2), np.int64)  # where their ids begin in flat, and how many
        self.flat = np.empty(0, np.int32)

    def _learn(self, hashes: np.ndarray, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        if len(self.known) + len(hashes) > self.most:
            self._forget()
        v = self.vocabulary
        sizes = stop - start
        ends = np.cumsum(sizes)
        own = chars[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1])]
        found = v.char[own]
        # What is no symbol is written by its character, below 0, and so is what only parts of pieces have.
        symbols, word = v.merge(np.where(found < 0, -1 - own.astype(np.int32), found), np.repeat(np.arange(len(sizes)), sizes))
        odd = (symbols < 0) | (symbols >= v.pieces)
        if odd.any():
            spelled = [[v.byte_id[b] for b in (chr(-1 - s) if s < 0 else v.spare[s - v.pieces]).encode()] for s in symbols[odd].tolist()]
            many = np.ones(len(symbols), np.int64)
            many[odd] = [len(x) for x in spelled]
            ids, word = np.repeat(symbols, many), np.repeat(word, many)
            ids[np.repeat(odd, many)] = [i for x in spelled for i in x]
        else:
            ids = symbols
        counts = np.bincount(word, minlength=len(sizes))
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.concatenate([self.place, np.stack([begin, counts], 1)])[order]

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        v = self.vocabulary
        texts = v.library.normalize(texts)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(chars):
            return [np.empty(0, np.int32) for _ in texts]
        kind = v.kind[chars]
        opens = np.ones(len(chars), bool)
        np.logical_not(v.joined[kind[:-1].astype(np.int32) * v.kinds + kind[1:]], out=opens[1:])
        opens[ends[ends < len(chars)]] = True
        start = np.flatnonzero(opens)
        stop = np.append(start[1:], len(chars))
        hashes = span_hashes(chars, start, stop, codes=v.code)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):  # learning may forget what was known
            where = np.searchsorted(self.known, distinct)
            new = np.flatnonzero(np.append(self.known, np.uint64(0))[where] != distinct) if len(self.known) else np.arange(len(distinct))
            new = np.union1d(new, np.flatnonzero(where == len(self.known)))
            if not len(new):
                break
            self._learn(distinct[new], chars, start[first[new]], stop[first[new]])
        place = self.place[np.searchsorted(self.known, distinct)][back]
        upto = np.cumsum(place[:, 1])
        ids = self.flat[np.repeat(place[:, 0] - upto + place[:, 1], place[:, 1]) + np.arange(upto[-1])]
        cuts = np.concatenate(([0], upto))[np.searchsorted(start, np.concatenate(([0], ends)))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin or end ids."""
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            size, stop = 0, len(out)
            while stop < len(texts) and (size < CHUNK or stop == len(out)):
                size += len(texts[stop])
                stop += 1
            out += self._some(texts[len(out) : stop])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the library makes of the ids: pieces after one another, a leading space off, bytes as UTF-8."""
        own = self.vocabulary.bytes
        try:
            text = b"".join([own[i] for i in ids])
            # The library takes each byte that is no part of a character on its own, and has signs for control and unknown ids.
            spaced = bool(ids) and text[:1] == b" " and ids[0] != self.vocabulary.byte_id[0x20]
            return text.decode()[spaced:]
        except (UnicodeDecodeError, TypeError):
            return self.vocabulary.library.decode(ids)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker, so that words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


IDS = pa.list_(pa.int32())


def _encode(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Columns key, text to key, ids and, if asked for, the text that the ids decode to."""
    own = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            ids = own.encode([t or "" for t in part.column(1).to_pylist()])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))]
            if decoded:
                columns.append(pa.array([own.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) of every row, ids those of the library's encode() by the model at `path`; `decoded` adds the text they decode to.

    Each worker reads the model at `path`. A null or empty text has no ids and decodes to an empty one. Repeated rows and rows
    without a key stay as they are, other columns are ignored, an empty table gives no rows. Texts are encoded whole, of any
    length.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    done = mapped(rows, partial(_encode, path=path, decoded=decoded), f"key {kind}, ids array<int>" + ", decoded string" * decoded)
    return done.withColumnRenamed("key", key)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["key", "decoded"])


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of every row: what the library's decode() makes of the ids. Null or empty ids give an empty text."""
    ready(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    done = mapped(rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids")), partial(_decode, path=path), f"key {kind}, decoded string")
    return done.withColumnRenamed("key", key)
