import random
import zlib

import numpy as np
import pytest

from coclave.llm import packing
from coclave.llm.tokens import WordEncoder
from tests.llm import odd

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def words():
    return WordEncoder(P.path("word_bpe_49k.json"), most=64)


def test_ids_are_the_tokenizers(words):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abSTrevlmd'''  0129½ª!?.\x85\xa0\x1cÉßñ\n\t-_") for _ in range(80)) for _ in range(150)]
    texts += ["don't 'tis we'll they've I'm", "", "'", "a'", "''s x''ve", "<|endoftext|> x", "日本 Σας İ", "é", odd.PROSE]
    for t in texts:
        assert words.encode([t])[0].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
    together = words.encode(texts)
    assert all(a.tolist() == words.encode([t])[0].tolist() for a, t in zip(together, texts, strict=True))


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.randint(3, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = {}, {n: set() for n in counts}
        for length, rank, n, first, offset in packing.plan(counts, capacity):
            for k in range(n):
                ranks[length].add(rank + k)
                used.setdefault(first + k, []).append((offset, length))
        assert {n: len(r) for n, r in ranks.items()} == counts
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        bins = []  # best fit of each document by itself
        for n in sorted(lengths, reverse=True):
            fit = min((b for b in bins if b[0] >= n), default=None)
            if fit is None:
                bins.append(fit := [capacity])
            fit[0] -= n
        assert len(used) <= len(bins) + 1


def test_whole_documents(spark, words):
    got = packing.pack(odd.documents(spark), P.path("word_bpe_49k.json"), capacity=64).collect()
    want = []
    for i, t, *_ in odd.rows():
        ids = [*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack(odd.empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_one_frequent_length_in_parts(spark):
    pieces = spark.range(5000).selectExpr("id as key", "0 as piece", "0L as start", "IF(id % 3 = 0, id % 50 + 1, 7) as length", "id as ids_crc32")
    got = packing.place(pieces, capacity=64, spread=100)
    assert got.count() == 5000 and got.select("sequence_id", "offset").distinct().count() == 5000
