import hashlib
import random
import re
import string

import numpy as np

from coclave.llm import secrets
from tests.llm import odd

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_fixed_patterns_against_plain_ones():
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "AKIA", "AKIAAKIA", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "ABCDEF0123", "-_.", "ſecret", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secrets.base_spans(text) == plain(text), text


def test_battery():
    rng = np.random.default_rng(1)
    accepted = [secrets.randomness(rng.integers(0, 64, 48), 64) >= secrets.RANDOM_LEVEL for _ in range(300)]
    assert np.mean(accepted) > 0.97
    assert secrets.randomness(np.zeros(48, int), 64) < secrets.RANDOM_LEVEL
    assert secrets.randomness(np.arange(64), 64) < secrets.RANDOM_LEVEL
    assert secrets.infer_encoding("abcdefghijklmnopqrstuv") is None
    assert secrets.infer_encoding("0123456789abcdef0123")[0] == "hex" and secrets.infer_encoding("MFRGGZDFMZTWQ2LK23")[0] == "base32"
    assert secrets.infer_encoding("aB3_-xyz09")[0] == "base64url"


def documents(spark, rng):
    alphabet = string.ascii_letters + string.digits
    rows = []
    for k in range(300):
        text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(60))
        if k % 10 == 0:
            text += " key " + "".join(rng.choices(alphabet, k=64)) + " end"
        if k % 10 == 5:
            text += " see chapter_two_section_three_part_12_of_the_book"
        rows.append((k, text))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_random_strings_are_found_and_prose_is_not(spark):
    got = {r["doc_id"]: r for r in secrets.find_secrets(documents(spark, random.Random(7))).collect()}
    assert all(("random:" in got[k]["spans"]) == (k % 10 == 0) for k in got)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = secrets.find_secrets(docs).collect()
    want = []
    for i, t, *_ in odd.rows():
        base = plain(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    hidden = secrets.hide_secrets(docs)
    assert hidden.columns == docs.columns and hidden.count() == len(want)
    assert hidden.filter("doc_id = 14").first()["text"] == "[SECRET]"
    assert secrets.find_secrets(odd.empty(spark)).count() == 0 and secrets.hide_secrets(odd.empty(spark)).count() == 0
