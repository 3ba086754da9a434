"""Language identification as inference of a mixture: what share of a text's words is in which language.

Each language has likelihoods of letter trigrams (hashed to a fixed number of cells) from labelled texts; a word's likelihood is
the product over its trigrams. Expectation-maximisation estimates the languages' shares in each text. Then languages leave one by
one, the smallest share first, while the likelihood penalised by half of log(words) for each language does not fall. The
language with the largest share is the prediction and the share its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.llm.textvec import mix
from coclave.runtime import mapped, ready

CELLS = 1 << 15
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of text that are worked on at a time.
CHUNK = 1 << 20


def trigram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of the trigram about each letter, where each word's letters begin); words begin and end with a space."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    about = np.flatnonzero(codes[1:-1] != 32)
    keys = (codes[about] << np.uint64(42)) | (codes[about + 1] << np.uint64(21)) | codes[about + 2]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (mix(keys) % np.uint64(CELLS)).astype(np.int64), np.cumsum(sizes) - sizes


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, word number) of every word with a letter, and the distinct words."""
    found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    codes, distinct = pd.factorize(np.array([w for x in found for w in x], object))
    real = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
    if not real.all():
        rank = np.cumsum(real) - 1
        owner, codes, distinct = owner[real[codes]], rank[codes[real[codes]]], distinct[real]
    return owner, codes, list(distinct)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            owner, codes, distinct = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang])
            if distinct:
                cells, _ = trigram_cells(distinct)
                often = np.repeat(np.bincount(codes, minlength=len(distinct)), [len(w) for w in distinct])
                seen[lang] = seen.get(lang, 0) + np.bincount(cells, often, CELLS)
    for lang, counts in seen.items():
        at = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], ["lang", "cell", "n"])


class Mixture:
    """langs: sorted; table: log-likelihoods, CELLS by languages."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Languages' shares of each text, of the selected set only; zeros for texts without a letter."""
        k = len(self.langs)
        out = np.zeros((len(texts), k))
        owner, codes, distinct = words_of(texts)
        if not distinct or not k:
            return out
        cells, begin = trigram_cells(distinct)
        word_ll = np.add.reduceat(self.table[cells], begin, axis=0)
        pairs, often = np.unique(owner * len(distinct) + codes, return_counts=True)
        owner, codes = np.divmod(pairs, len(distinct))
        told, first = np.unique(owner, return_index=True)
        row = np.repeat(np.arange(len(told)), np.diff(np.append(first, len(owner))))
        top = word_ll.max(1, keepdims=True)
        like = np.exp(np.maximum(word_ll - top, -80))[codes]
        often = often.astype(np.float64)
        n = np.add.reduceat(often, first)

        def maximise(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                part = like * share[row]
                part *= (often / np.maximum(part.sum(1), 1e-300))[:, None]
                share = np.add.reduceat(part, first, axis=0) / n[:, None]
            fit = np.add.reduceat(often * np.log(np.maximum((like * share[row]).sum(1), 1e-300)), first)
            return share, fit

        share, fit = maximise(np.full((len(told), k), 1 / k), 6)
        active = np.ones_like(share, bool)
        open_ = np.ones(len(told), bool)
        for _ in range(k - 1):
            least = np.where(active, share, np.inf).argmin(1)
            fewer = active.copy()
            fewer[np.arange(len(told)), least] = False
            start = np.where(fewer, share + 1e-9, 0.0)
            trial, trial_fit = maximise(start / start.sum(1, keepdims=True), 3)
            better = open_ & (trial_fit + 0.5 * np.log(np.maximum(n, 2)) >= fit)
            share[better], fit[better], active[better] = trial[better], trial_fit[better], fewer[better]
            open_ &= better
            if not open_.any():
                break
        out[told] = share / share.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop] or "") <= CHUNK):
                held += len(texts[stop] or "")
                stop += 1
            share = self.shares(texts[at:stop])
            best = share.argmax(1) if len(self.langs) else np.zeros(stop - at, int)
            score = share.max(1) if len(self.langs) else np.zeros(stop - at)
            langs += [self.langs[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)]
            scores.append(np.minimum(score, 1.0))
            at = stop
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 20_000) -> Mixture:
    """Learn from about `rows` of the labelled texts at most, picked by a hash of their key; null texts and labels teach nothing."""
    ready(labelled.sparkSession)
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = min(1.0, rows / max(1, usable.select(lang).count()))
    picked = usable.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    counted = (
        mapped(picked.select(F.col(text).cast("string"), F.col(lang).cast("string")), _count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counted["lang"].unique())
    counts = np.full((CELLS, len(langs)), 0.1)
    for k, name in enumerate(langs):
        own = counted[counted["lang"] == name]
        counts[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return Mixture(langs, np.log(counts / counts.sum(0)).astype(np.float32))


def _predict(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = model.predict(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])


def identify(docs: DataFrame, model: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row, from its whole text alone.

    `und` and 0 where the text is null or has no letter, and where nothing was learned. At a tie the first language by name
    is predicted. Null and repeated keys give a row each; other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return mapped(rows, partial(_predict, model=model), "key long, lang_pred string, score double").withColumnRenamed("key", key)


def _select(batches: Iterator[pa.RecordBatch], model: Mixture, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = model.predict(batch.column(0).to_pylist())
        yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))


def keep_identified(docs: DataFrame, model: Mixture, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose text has a language with a share of `least` or more."""
    ready(docs.sparkSession)
    names = docs.columns
    moved = docs.select(text, *(c for c in names if c != text))
    return mapped(moved, partial(_select, model=model, least=least), moved.schema).select(*names)
