"""Secrets that no fixed pattern covers, planted in prose: how many the battery finds, and what else it takes for one."""

import random
import string

import pyarrow as pa

from coclave.llm import secrets

WORDS = "the of and in to is was for on are with as by at from that this it be or an which you were have has not but they all one can had their there been if more when will would who so no out up into than them some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
LETTERS, DIGITS = string.ascii_letters, string.digits
#: Kind of key: alphabet, length, the least share of keys that must be found.
KEYS = {
    "base62 of 20": (LETTERS + DIGITS, 20, 0.6), "base62 of 24": (LETTERS + DIGITS, 24, 0.8), "base62 of 40": (LETTERS + DIGITS, 40, 0.95), "base64 of 32": (LETTERS + DIGITS + "+/", 32, 0.95),
    "hex of 40": ("0123456789ABCDEF", 40, 0.7), "mixed letters of 40": (LETTERS, 40, 0.9), "lower letters of 48": (string.ascii_lowercase, 48, 0.5),
}


def test_recall_and_false_discoveries():
    rng = random.Random(21)
    texts, planted = [], []
    for k in range(2800):
        words = rng.choices(WORDS, k=rng.randint(30, 150))
        words += ["-".join(rng.choices(WORDS, k=5)), "_".join(rng.choices(WORDS, k=4)), "x" * 20, "1998", "/".join(rng.choices(WORDS, k=6))] if k % 5 == 0 else []
        kind = list(KEYS)[k // 10 % len(KEYS)] if k % 10 == 3 else None
        key = "".join(rng.choices(KEYS[kind][0], k=KEYS[kind][1])) if kind else ""
        words.insert(rng.randrange(len(words)), key)
        texts.append(" ".join(words))
        planted.append((kind, key))
    counts = [0] * 128
    for t in texts:
        for c in t:
            counts[ord(c)] += 1
    scanner = secrets.Scanner(counts)
    (binned,) = scanner.histogram(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    scanner.cuts = secrets.cuts_of(binned.to_pylist(), 0.01)
    found, asked, false = dict.fromkeys(KEYS, 0), dict.fromkeys(KEYS, 0), 0
    for text, (kind, key) in zip(texts, planted, strict=True):
        spans = [text[a:b] for a, k, b in scanner.spans(text) if k == 3]
        false += sum(not key or s not in key for s in spans)
        if kind:
            asked[kind] += 1
            found[kind] += any(s in key for s in spans)
    for kind, (_, _, least) in KEYS.items():
        assert asked[kind] == 40 and found[kind] >= least * asked[kind], (kind, found[kind])
    assert false <= 0.02 * sum(found.values())
