"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Fixed patterns are found over the whole text. Besides them, runs of 16 and more encoding characters are candidates; shorter ones
could hardly be told from text by any test here. A run that no alphabet holds, with + or / beside - or _, is split at either pair.
For each, the encoding is inferred (hexadecimal, base 32, base 64, or letters only) and three tests are made of the hypothesis that it
is random in that alphabet: chi-squared uniformity, runs about the middle of the alphabet, and serial correlation; Fisher's method
combines them. A candidate that passes as random is a discovery if ordinary text would hardly look so even: the p-value of its
chi-squared statistic under the corpus's own character frequencies, which falls with length. Benjamini and Hochberg's rule is
applied to these within classes of length over the candidates of all documents. Runs of one class of characters, and pieces of
runs, have classes of their own: there are many in prose, and they would take power from the others.

The corpus gives 128 character counts and a histogram of p-values per length class; both have a fixed size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.runtime import mapped, ready

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns. Bounds on length that cannot change which runs match are in the pattern, the others are tested after it.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Alphabets of runs of one class of characters, which infer_encoding() has none for.
PLAIN = (("digits", "0123456789"), ("lower", "abcdefghijklmnopqrstuvwxyz"), *ALPHABETS[2:])
LEAST = 16
LENGTH_CLASSES = (20, 28, 40, 64, 128)
#: Length classes of a kind of candidate: runs that mix letters and digits, runs of one class of characters, pieces of runs.
LEVELS = len(LENGTH_CLASSES) + 1
#: Candidates rejected as random at this level are dropped.
RANDOM_LEVEL = 0.001
#: Weight of a letter's frequency in both cases beside that in its own: a corpus may hold a case in little but secrets.
FOLDED = 0.05
BINS = 400  # of -log10 p, ten to a unit


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, stop) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer_encoding(run: str) -> tuple[str, np.ndarray] | None:
    """The narrowest alphabet that holds the run, and its values there; none for runs of one class of characters."""
    body = run.rstrip("=")
    digits = any("0" <= c <= "9" for c in body)
    letters = any(c.isalpha() for c in body)
    if not digits or not letters:
        return None
    for name, alphabet in ALPHABETS:
        at = [alphabet.find(c) for c in body]
        if min(at) >= 0:
            return name, np.array(at)
    return None


def plain_encoding(run: str) -> tuple[str, np.ndarray] | None:
    """The narrowest alphabet that holds a run of letters or of digits alone, and its values there."""
    body = run.rstrip("=")
    for name, alphabet in PLAIN:
        at = [alphabet.find(c) for c in body]
        if min(at) >= 0:
            return name, np.array(at)
    return None


def pieces(run: str) -> list[tuple[int, int]]:
    """(from, to) of what a run that no alphabet holds has between its hyphens and underscores, and between its + and /."""
    if not (set(run) & set("+/") and set(run) & set("-_")):
        return []
    found = {m.span() for odd in ("-_", "+/") for m in re.finditer(f"[^{odd}]{{{LEAST},}}", run)}
    return sorted(found)


def outside(start: int, stop: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans leave of a run, where it is long enough."""
    found = []
    for a, b in [*spans, (stop, stop)]:
        found += [(start, min(a, stop))] if a > start else []
        start = max(start, b)
    return [(a, b) for a, b in found if b - a >= LEAST]


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(values: np.ndarray, size: int) -> float:
    expected = len(values) / size
    return float(((np.bincount(values, minlength=size) - expected) ** 2).sum() / expected)


def randomness(values: np.ndarray, size: int) -> float:
    """Fisher's combination of the three tests: a small value speaks against a uniform random string."""
    n, k = len(values), size - 1
    x = chi_squared(values, size)
    uniform = 2 * min(_tail(z := ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))), _tail(-z))
    high = values >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 2 * _tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    d = values - values.mean()
    total = float(d @ d)
    serial = 2 * _tail(abs((float(d[1:] @ d[:-1]) / total + 1 / n) * math.sqrt(n))) if total else 2.0 ** (1 - n)
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def text_p(values: np.ndarray, alphabet: str, counts: np.ndarray) -> float:
    """How likely ordinary text of this length is to spread so evenly over the alphabet; normal approximation."""
    size, n = len(alphabet), len(values)
    at = [ord(c) for c in alphabet]
    own = counts[at] + FOLDED * (counts[[ord(c.lower()) for c in alphabet]] + counts[[ord(c.upper()) for c in alphabet]]) / 2 + 1.0
    delta = float((((own / own.sum()) - 1 / size) ** 2).sum() * size)
    mean, var = size - 1 + (n - 1) * delta, 2 * (size - 1) + 4 * n * delta
    return max(_tail((mean - chi_squared(values, size)) / math.sqrt(var)), 1e-39)


class Scanner:
    """Works on one text at a time; counts: of the 128 ASCII characters; cuts: the least bin accepted by length class."""

    def __init__(self, counts: list[int] | None = None, cuts: dict[int, int] | None = None):
        self.counts, self.cuts = np.array(counts or [0] * 128, np.float64), cuts or {}

    def candidates(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(start, stop, length class, bin of its p-value) of runs that pass as random, or of what fixed spans leave of them."""
        for m in CANDIDATE.finditer(text):
            touched = [(a, b) for a, _, b in base if a < m.end() and m.start() < b]
            for at, end in outside(m.start(), m.end(), touched) if touched else [m.span()]:
                whole = text[at:end]
                split = pieces(whole)
                for start, stop in split or [(0, len(whole))]:
                    run = whole[start:stop]
                    found, kind = infer_encoding(run), 2 if split or touched else 0
                    if found is None:
                        found, kind = plain_encoding(run), kind or 1
                    if found is None or (tested := self.tested(*found)) is None:
                        continue
                    level, p = tested
                    yield at + start, at + stop, LEVELS * kind + level, p

    def tested(self, name: str, values: np.ndarray) -> tuple[int, int] | None:
        """(length class, bin of its p-value) of a run that passes as random in the alphabet."""
        alphabet = dict(ALPHABETS + PLAIN)[name]
        if randomness(values, len(alphabet)) < RANDOM_LEVEL:
            return None
        level = sum(len(values) >= x for x in LENGTH_CLASSES)
        return level, min(BINS - 1, int(-10 * math.log10(text_p(values, alphabet, self.counts))))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        return sorted(base + [(a, 3, b) for a, b, level, p in self.candidates(text, base) if p >= self.cuts.get(level, BINS)])

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((3 * LEVELS, BINS), np.int64)
        for batch in batches:
            for t in batch.column(0):
                if text := t.as_py():
                    for _, _, level, p in self.candidates(text, base_spans(text)):
                        seen[level, p] += 1
        level, p = seen.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(p, pa.int32()), pa.array(seen[level, p])], ["level", "bin", "n"])

    def digest(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = self.spans(t.as_py() or "")
                base = [x for x in found if x[1] < 3]
                rows.append((*(sum(k == x[1] for x in base) for k in range(3)), sha256(say(base).encode()).hexdigest(), say(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    def hide(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch with every span in its first column written as [SECRET]; other columns as they are."""
        for batch in batches:
            out = []
            for t in batch.column(0):
                text = t.as_py()
                if text is not None:
                    parts, at = [], 0
                    for a, _, b in self.spans(text):
                        if b > at:
                            parts += [text[at:a], "[SECRET]"] if a >= at else []
                            at = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:]], batch.schema.names)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(256, np.int64)
    for batch in batches:
        for buffer in batch.column(0).cast(pa.binary()):
            if buffer.is_valid:
                seen += np.bincount(np.frombuffer(buffer.as_buffer(), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(128, dtype=np.int32)), pa.array(seen[:128])], ["code", "n"])


def cuts_of(binned: list, false_discoveries: float) -> dict[int, int]:
    """The least bin that is a discovery by Benjamini and Hochberg's rule, of each level of rows (level, bin, n) that has one."""
    cuts = {}
    for level in {r["level"] for r in binned}:
        own = {r["bin"]: r["n"] for r in binned if r["level"] == level}
        total, above = sum(own.values()), 0
        for p in sorted(own, reverse=True):
            above += own[p]
            if total * 10 ** (-p / 10) <= false_discoveries * above:
                cuts[level] = p
    return cuts


def fit(docs: DataFrame, text: str = "text", false_discoveries: float = 0.01) -> Scanner:
    """A scanner with the character counts and cuts of all documents."""
    ready(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    counted = mapped(texts, _characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = [0] * 128
    for r in counted:
        counts[r["code"]] = r["n"]
    scanner = Scanner(counts)
    binned = mapped(texts, scanner.histogram, "level int, bin int, n long").groupBy("level", "bin").agg(F.sum("n").alias("n")).collect()
    scanner.cuts = cuts_of(binned, false_discoveries)
    return scanner


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Null texts count as empty and have no span; null and repeated keys give a row each; other columns are ignored. Spans are
    code points, end exclusive, by start and then kind.
    """
    scanner = scanner or fit(docs, text)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    out = "key long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return mapped(rows, scanner.digest, out).withColumnRenamed("key", key)


def hide_secrets(docs: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """The rows with each secret in their text replaced by [SECRET]; every row and all other columns stay as they are."""
    scanner = scanner or fit(docs, text)
    names = docs.columns
    moved = docs.select(text, *(c for c in names if c != text))
    return mapped(moved, scanner.hide, moved.schema).select(*names)
