"""Quality by ordinal regression: a cumulative-link model over hashed text.

A document with score f has a grade of k at most with probability sigmoid(threshold_k - f); the thresholds are ordered, the
weights in f shared by all grades. Features are the presence of hashed words and runs of marks and bins of a few measures of
style; only those that a test finds to depend on the grade get a weight. The penalty on weights is chosen by cross-validation on
the labelled documents. From the model come the expected grade and the probability of reaching a grade, by which documents are
selected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.llm.textvec import LOWER, SPACE, distinct, mix, span_hashes
from coclave.runtime import cut, mapped, ready

WORD_SLOTS = 1 << 20
MEASURES, BINS = 7, 12
#: Bytes of a word's beginning that count as a feature of their own.
BEGINNINGS = (6, 8)
SLOTS = WORD_SLOTS + MEASURES * BINS
CHUNK = 1 << 20
PENALTIES = (0.5, 2.0, 8.0)
#: ASCII letters, digits and the bytes of other characters count as part of words, the rest as marks.
WORDLY = np.zeros(256, bool)
WORDLY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True


def slots_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted slots that each text has set: its distinct words, their beginnings, its runs of marks, these with the magnitude of their share, and one bin per measure."""
    data = np.frombuffer(b" ".join([*texts, b" "]), np.uint8)
    word, gap = WORDLY[data], SPACE[data]
    mark = ~(word | gap)
    lower = LOWER[data]

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate((inside[:1], inside[1:] != inside[:-1])))
        return edge[::2], edge[1::2]

    start, stop = runs(word)
    hashes = span_hashes(lower, start, stop)
    kinds = [hashes]
    for k, n in enumerate(BEGINNINGS):
        kinds.append(mix(np.where(stop - start > n, span_hashes(lower, start, np.minimum(stop, start + n)), hashes) + np.uint64(k + 1)))
    slots = np.stack([(h % np.uint64(WORD_SLOTS)).astype(np.int64) for h in kinds], 1)
    mark_start, mark_stop = runs(mark)
    mark_hash = mix(span_hashes(data, mark_start, mark_stop) + np.uint64(99))
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    mark_bounds = np.concatenate(([0], np.searchsorted(mark_start, ends)))
    sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (word, mark, UPPER[data], DIGIT[data])]
    repeats = np.concatenate(([0], np.cumsum(again)))
    out, begin = [], 0
    for k, end in enumerate(ends.tolist()):
        a, b = int(bounds[k]), int(bounds[k + 1])
        own = distinct(slots[a:b].ravel())
        marks, often = np.unique(mark_hash[mark_bounds[k] : mark_bounds[k + 1]], return_counts=True)
        n = max(1, end - 1 - begin)
        letters, signs, upper, digits = (int(s[end - 1] - s[begin]) if end - 1 > begin else 0 for s in sums)
        words = max(1, b - a)
        levels = np.floor(np.log2(often * 64 / words)).clip(0, 8).astype(np.uint64) + np.uint64(1)
        signed = np.concatenate([marks, marks + levels])
        values = (signs / n * 4, upper / max(1, letters) * 2, digits / n * 4, len(own) / (3 * words) ** 0.9, np.log2(words + 1) / 16, letters / words / 16, int(repeats[b] - repeats[a]) / words * 2)
        bins = [WORD_SLOTS + m * BINS + min(BINS - 1, int(v * BINS)) for m, v in enumerate(values)]
        out.append(distinct(np.concatenate([own, (mix(signed) % np.uint64(WORD_SLOTS)).astype(np.int64), np.array(bins, np.int64)])))
        begin = end
    return out


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in column:
        held.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Grades:
    """P(grade >= k) is sigmoid(f - thresholds[k - 1]) for k from 1; weights are 0 where nothing was learned."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def reach(self, texts: list[bytes]) -> np.ndarray:
        f = np.array([self.weights[s].sum() for s in slots_of(texts)])
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None], -40, 40)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [s for chunk in _chunks(batch.column(0)) for s in slots_of(chunk)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([s.astype("<i4").tobytes() for s in slots], pa.binary())], ["grade", "slots"])


def telling(grades: np.ndarray, slots: list[np.ndarray], least: int = 4, level: float = 0.05) -> np.ndarray:
    """The slots whose presence depends on the grade: likelihood-ratio tests, at `level` over all slots together.

    Most words of a corpus say nothing of grades; left in, thousands of them fit the noise of the learned documents.
    """
    levels, n = int(grades.max()) + 1, np.bincount(grades)
    owner = np.repeat(grades, [len(s) for s in slots])
    held = np.bincount(np.concatenate(slots).astype(np.int64) * levels + owner, minlength=SLOTS * levels).reshape(-1, levels)
    total = held.sum(1)
    used = np.flatnonzero((total >= min(least, len(grades))) & (total < len(grades)))
    if not len(used) or levels < 2:
        return used
    seen, with_it = held[used].astype(np.float64), total[used][:, None]
    ratio = np.zeros(len(used))
    for count, expected in ((seen, with_it * n / len(grades)), (n - seen, (len(grades) - with_it) * n / len(grades))):
        ratio += 2 * (count * np.log(np.where(count > 0, count, 1) / np.where(count > 0, expected, 1))).sum(1)
    # Wilson and Hilferty's normal approximation of the chi-squared tail, exact enough where it is this small.
    k = levels - 1
    cut = k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(1 - level / len(used)) * math.sqrt(2 / (9 * k))) ** 3
    return used[ratio >= cut]


class Likelihood:
    """The mean penalised negative log-likelihood of grades given slots, with x = weights of `used`, first threshold, log gaps."""

    def __init__(self, grades: np.ndarray, slots: list[np.ndarray], used: np.ndarray, levels: int, penalty: float):
        self.grades, self.levels, self.penalty, self.size = grades, levels, penalty, len(used)
        rank = np.full(SLOTS, -1, np.int32)
        rank[used] = np.arange(len(used))
        flat = rank[np.concatenate(slots)] if slots else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        self.flat, self.owner = flat[flat >= 0], owner[flat >= 0]

    def start(self) -> np.ndarray:
        share = [np.clip((self.grades >= k).mean(), 0.01, 0.99) for k in range(1, self.levels + 1)]
        first = [-np.log(p / (1 - p)) for p in share]
        return np.concatenate([np.zeros(self.size), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """(value, slope) at x."""
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        grades, n = self.grades, len(self.grades)
        w, first, gaps = x[: self.size], x[self.size], np.exp(x[self.size + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        f = np.bincount(self.owner, w[self.flat], n)
        below, upto = sigmoid(cuts[grades] - f), sigmoid(cuts[grades + 1] - f)
        below[grades == 0], upto[grades == self.levels] = 0.0, 1.0
        p = np.maximum(upto - below, 1e-9)
        d_below, d_upto = below * (1 - below) / p, upto * (1 - upto) / p
        slope_f = d_upto - d_below
        slope_cuts = np.bincount(grades, d_below, self.levels + 1)[1:] - np.bincount(grades, d_upto, self.levels + 1)[:-1]
        later = np.cumsum(slope_cuts[::-1])[::-1]
        slope = np.concatenate([np.bincount(self.flat, slope_f[self.owner], self.size) + self.penalty * w, [later[0]], later[1:] * gaps])
        return float(-np.log(p).sum() + self.penalty / 2 * w @ w) / n, slope / n


def train(grades: np.ndarray, slots: list[np.ndarray], rounds: int = 80, penalty: float = 2.0) -> Grades:
    """Full-batch Adam on the penalised likelihood, over the telling slots."""
    weights = np.zeros(SLOTS, np.float32)
    if not len(grades):
        return Grades(weights, np.zeros(1))
    used = telling(grades, slots)
    likelihood = Likelihood(grades, slots, used, max(1, int(grades.max())), penalty)
    x = likelihood.start()
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        _, slope = likelihood(x)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = x[: len(used)]
    return Grades(weights, x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1 :]))]))


def surprise(model: Grades, grades: np.ndarray, slots: list[np.ndarray]) -> float:
    """The mean negative log-likelihood of the grades under the model."""
    f = np.array([model.weights[s].sum() for s in slots])
    reach = np.concatenate([np.ones((len(f), 1)), 1 / (1 + np.exp(-np.clip(f[:, None] - model.thresholds[None], -40, 40))), np.zeros((len(f), 1))], 1)
    at = np.arange(len(f)), np.minimum(grades, reach.shape[1] - 2)
    return float(-np.log(np.maximum(reach[at] - reach[at[0], at[1] + 1], 1e-9)).mean())


def choose_penalty(grades: np.ndarray, slots: list[np.ndarray], folds: int = 3) -> float:
    """That of PENALTIES with the least surprise over the folds held out in turn; slots are chosen anew in each."""
    fold = np.arange(len(grades)) % folds
    if len(grades) < 10 * folds or any(grades[fold != k].max() != grades.max() for k in range(folds)):
        return PENALTIES[-1]
    told = []
    for penalty in PENALTIES:
        models = [train(grades[fold != k], [s for s, f in zip(slots, fold, strict=True) if f != k], penalty=penalty) for k in range(folds)]
        told.append(sum(surprise(m, grades[fold == k], [s for s, f in zip(slots, fold, strict=True) if f == k]) for k, m in enumerate(models)))
    return PENALTIES[int(np.argmin(told))]


def fit(docs: DataFrame, labels: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", rows: int = 8_000) -> Grades:
    """Learn from about `rows` labelled documents at most, picked by a hash of their key; null grades and texts teach nothing.

    `grade` is an expression over `labels`, integers from 0. A document with several labels is learned with each different one. Equal
    rows of either table count once, and should keys with several texts make more pairs than `rows`, a hash of the pair picks again.
    """
    ready(docs.sparkSession)
    graded = cut(labels.select(F.col(key).alias("__key"), grade.cast("int").alias("grade")).filter("grade is not null and __key is not null").distinct())
    part = lambda share, *of: F.pmod(F.xxhash64(*of), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    picked = graded.filter(part(min(1.0, rows / max(1, graded.count())), F.col("__key").cast("string")))
    joined = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").cast("binary").alias("text")).filter("text is not null").join(F.broadcast(picked), "__key")
    # Told apart by a hash, so that repeats meet as numbers and not as texts; what is left is the sample, and small.
    pairs = cut(joined.withColumn("__hash", F.xxhash64("text")).groupBy("__key", "grade", "__hash").agg(F.first("text").alias("text")))
    if (n := pairs.count()) > 2 * rows:
        pairs = pairs.filter(part(rows / n, F.col("__key").cast("string"), "grade", "__hash"))
    found = mapped(pairs.select("text", "grade"), _featurise, "grade int, slots binary").toArrow().combine_chunks()
    # The order of the rows, and with it the folds, must not depend on partitions.
    rows_ = sorted(zip(found.column("grade").to_pylist(), found.column("slots").to_pylist(), strict=True))
    grades, slots = np.array([g for g, _ in rows_], np.int64), [np.frombuffer(s, "<i4") for _, s in rows_]
    return train(grades, slots, penalty=choose_penalty(grades, slots))


def _grade(batches: Iterator[pa.RecordBatch], model: Grades, level: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reach = np.concatenate([model.reach(chunk) for chunk in _chunks(batch.column(1))]) if batch.num_rows else np.zeros((0, len(model.thresholds)))
        tail = reach[:, level - 1] if level <= reach.shape[1] else np.zeros(len(reach))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reach.sum(1)), pa.array(tail), pa.array(tail >= least)], ["key", "expected_grade", "tail", "kept"])


def grade_documents(docs: DataFrame, model: Grades, level: int = 2, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_grade, tail, kept) for every row, from its whole text: tail is P(grade >= level), kept tail >= least.

    Null and empty texts are graded by their measures alone; null and repeated keys give a row each; other columns are ignored.
    """
    ready(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))
    done = mapped(rows, partial(_grade_given, given=given, level=level, least=least), "key long, expected_grade double, tail double, kept boolean")
    return done.withColumnRenamed("key", key)


def _grade_given(batches: Iterator[pa.RecordBatch], given: object, level: int, least: float) -> Iterator[pa.RecordBatch]:
    yield from _grade(batches, given.value, level, least)
