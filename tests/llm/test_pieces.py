import random

import pytest

from coclave.llm import pieces
from coclave.llm.pieces import PieceEncoder
from coclave.llm.queries import piece_model
from tests.llm.odd import documents, empty, rows


@pytest.fixture(scope="module")
def own():
    return PieceEncoder(piece_model(), most=500)


def texts():
    rng = random.Random(5)
    library = pieces.Vocabulary(piece_model()).library
    vocabulary = [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    letters = ["a", "b", "e", "t", "h", " ", "▁", "\n", "é", "日", "本", "\0", "Ω", "𝔘", "ﷺ", "　", "0", "1", "-", "="]
    out = ["", " ", "<s> </s> <0x0A> <unk>", "a" * 20_000, " " * 9_001, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9_000))]
    for _ in range(400):
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
        out.append("".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))))
        out.append("".join(rng.choice("ab ") for _ in range(rng.randint(0, 150))))
        out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 40))))
    return out


def test_ids_and_decoding_are_those_of_the_library(own):
    library, given = own.vocabulary.library, texts()
    want = library.encode(given)
    assert [x.tolist() for x in own.encode(given)] == want
    assert [own.decode(x) for x in want] == [library.decode(x) for x in want]


def test_any_ids_decode_as_with_the_library(own):
    library, rng = own.vocabulary.library, random.Random(6)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(260)]) for _ in range(rng.randint(0, 8))] for _ in range(2_000)]
    ids += [[i] for i in range(2_000)] + [[259, i] for i in range(300)]
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_one_by_one_makes_the_same_merges(own):
    v, rng = own.vocabulary, random.Random(7)
    for _ in range(200):
        word = [int(v.char[ord(c)]) for c in "".join(rng.choice("tabhe▁") for _ in range(rng.randint(1, 40)))]
        merged, _ = v.merge(pieces.np.array(word, pieces.np.int32), pieces.np.zeros(len(word), int))
        assert v.one_by_one(word) == merged.tolist()


def test_odd_tables(spark, own):
    path, library = piece_model(), own.vocabulary.library
    found = pieces.encode(documents(spark), path, decoded=True)
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows()), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in found.collect()), key=str) == want
    again = pieces.decode(found.drop("decoded"), path)
    assert sorted(((r[0], r[1]) for r in again.collect()), key=str) == sorted(((i, t) for i, _, t in want), key=str)
    assert pieces.encode(empty(spark), path).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), path).collect() == [(1, ""), (2, "")]

