"""Token ids of many texts at once, exactly as the given tokenizer has them.

The vocabulary of word_bpe files splits a normalised text into words and merges within each, so that a word's ids do not
depend on its neighbours. Texts of Latin-1 characters are split with array operations, each distinct word is merged once by the
tokenizer's own model, and ids are put together by gathering. All other texts, and those that could hold a special token, go
through the tokenizer itself.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from coclave.llm.textvec import span_hashes

SPACES, OTHER, NUMBER, LETTER = range(4)
#: Classes and lower case of the Latin-1 characters.
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACES
KIND[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Keeps the ids of up to `most` distinct words between calls; at that number it starts anew."""

    def __init__(self, path: str, most: int = 1 << 18):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        letters = byte_letters()
        self.written = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.place = np.empty((0, 2), np.int64)  # where their ids begin in flat, and how many
        self.flat = np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.most:
            self._forget()
        merge, written = self.tokenizer.model.tokenize, self.written
        ids = [[t.id for t in merge(w.decode("latin-1").translate(written))] for w in words]
        sizes = np.array([len(x) for x in ids], np.int64)
        begin = len(self.flat) + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.concatenate([self.place, np.stack([begin, sizes], 1)])[order]

    def _fast(self, texts: list[bytes]) -> list[np.ndarray]:
        data = LOWER[np.frombuffer(b" ".join([*texts, b" "]), np.uint8)]
        kind = KIND[data]
        opens = np.ones(len(data), bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # 's 't 'm 'd 're 've 'll at the head of a run of marks are words of their own.
        at = np.flatnonzero((data == 0x27) & opens)
        at = at[at + 2 < len(data)]
        at = at[kind[at + 1] == LETTER]
        if len(at):
            one, two = data[at + 1], data[at + 2]
            tail = np.isin(one, np.frombuffer(b"stmd", np.uint8)) * 1
            tail += 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            at, tail = at[tail > 0], tail[tail > 0]
            opens[at + 1] = False
            after = at + 1 + tail
            opens[after[kind[after] == LETTER]] = True
        edge = np.flatnonzero(opens)
        stop = np.append(edge[1:], len(data))
        real = kind[edge] != SPACES
        start, stop = edge[real], stop[real]
        hashes = span_hashes(data, start, stop)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(distinct) > self.most // 2 and len(texts) > 1:
            half = len(texts) // 2
            return self._fast(texts[:half]) + self._fast(texts[half:])
        for _ in range(2):  # learning may forget what was known
            where = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            new = np.flatnonzero(self.known[where] != distinct) if len(self.known) else np.arange(len(distinct))
            if not len(new):
                break
            self._learn(distinct[new], [data[start[k] : stop[k]].tobytes() for k in first[new]])
        where = np.searchsorted(self.known, distinct)
        place = self.place[where][back] if len(distinct) else np.empty((0, 2), np.int64)
        ends = np.cumsum(place[:, 1])
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(place[:, 0] - ends + place[:, 1], place[:, 1]) + np.arange(total)]
        bounds = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], bounds))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        fast, at = [], []
        for k, t in enumerate(texts):
            try:
                if "<|" in t:
                    raise UnicodeError
                fast.append(t.encode("latin-1"))
                at.append(k)
            except UnicodeError:
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        for k, ids in zip(at, self._fast(fast) if fast else [], strict=True):
            out[k] = ids
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, so that words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
