"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: One random odd-ish 64-bit number per byte value, and the base of the rolling polynomial.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "base" else BASE_INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int = 1 << 15, codes: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands; spans sorted and disjoint. `codes` numbers other units.

    Whole texts of any length: the running sums are taken over stretches of about `most` bytes, cut between spans.
    """
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        a = int(start[k])
        e = max(k + 1, int(np.searchsorted(stop, a + most, "right")))
        b = int(stop[e - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(codes[data[a:b]] * _power("base", b - a), out=sums[1:])
        s, t = start[k:e] - a, stop[k:e] - a
        out[k:e] = mix((sums[t] - sums[s]) * _power("inverse", b - a)[s] + (t - s).astype(np.uint64))
        k = e
    return out


#: The bytes between words, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts after one another, where each text's words begin, with the end): A-Z in lower case."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    gap = SPACE[data]
    edge = np.flatnonzero(np.concatenate((~gap[:1], gap[1:] != gap[:-1])))  # the last byte is a gap
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return span_hashes(data, start, stop), np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `width` words; a shorter text is one run; no words, no runs."""
    hashes, begin = words(texts)
    n = len(hashes)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * BASE + hashes[k : n - width + 1 + k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                with np.errstate(over="ignore"):
                    whole = whole * BASE + h
            out.append(mix(np.array([whole])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
