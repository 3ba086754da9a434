import random
import string

from coclave.llm import secrets

BASE64 = string.ascii_letters + string.digits + "+/"


def found(keys):
    """Which of the keys have a random span of their own, in prose, by a scanner that fit() would give."""
    rng = random.Random(2)
    prose = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(60)) for _ in keys]
    texts = [f"{p} see {k} end" for p, k in zip(prose, keys, strict=True)]
    counts = [0] * 128
    for c in "".join(texts):
        counts[ord(c)] += 1
    first = secrets.Scanner(counts)
    seen = {}
    for t in texts:
        for _, _, level, p in first.candidates(t, secrets.base_spans(t)):
            seen.setdefault(level, []).append(p)
    cuts = {level: min(ps) for level, ps in seen.items() if len(ps) * 10 ** (-min(ps) / 10) <= 0.01 * len(ps)}
    scanner = secrets.Scanner(counts, cuts)
    return sum(any(k == 3 and t[a:b] in key for a, k, b in scanner.spans(t)) for t, key in zip(texts, keys, strict=True))


def test_letters_only_short_and_mixed_runs_are_candidates():
    rng = random.Random(9)
    make = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    scanner = secrets.Scanner()
    for alphabet, n, tail in ((string.ascii_letters, 24, ""), (string.ascii_uppercase, 24, ""), (string.ascii_letters + string.digits, 17, ""), (BASE64, 40, "/a-b")):
        got = sum(bool(list(scanner.candidates(t, secrets.base_spans(t)))) for t in (f"see {make(alphabet, n)}{tail} end" for _ in range(40)))
        assert got >= 35, (alphabet, n, got)
    assert found([make(string.ascii_letters, 32) for _ in range(40)]) >= 35


def test_pieces_split_at_either_pair():
    assert secrets.pieces("a" * 20 + "/x-" + "b" * 17) == [(0, 20), (0, 22), (21, 40), (23, 40)]
    assert secrets.pieces("a" * 20 + "-" + "b" * 20) == []


def test_what_a_fixed_span_leaves_of_a_run_is_a_candidate():
    rng = random.Random(3)
    key = "".join(rng.choices(BASE64[:62], k=40))
    access = "AKIA" + "ABCDEFGHIJKL"
    scanner = secrets.Scanner()
    for text, at in ((f"see {access}/{key} end", 20), (f"see {key}_{access} end", 4)):
        got = list(scanner.candidates(text, secrets.base_spans(text)))
        assert any(a <= at + 1 and b >= at + 40 for a, b, _, _ in got), text
    assert secrets.outside(0, 60, [(20, 30), (25, 40)]) == [(0, 20), (40, 60)] and secrets.outside(0, 60, [(0, 60)]) == []
    text = "password=" + key
    assert not list(scanner.candidates(text, secrets.base_spans(text)))
