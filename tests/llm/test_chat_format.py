import random

from pyspark.sql import functions as F

from coclave.llm import chat_format


def formatted(df):
    done = chat_format.format_chats(df)
    return done.select("conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_round_trip(spark):
    rng = random.Random(8)
    bits = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "|", ">", "a", "é😀", "<|end|>\n", "<|sep|>", "<|user|>\n", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|>\nb"]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(80) for t in range(rng.randint(1, 7))]
    got = {r["conv_id"]: r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    for c, r in got.items():
        own = [(x[2], x[3]) for x in rows if x[0] == c]
        assert [(t["role"], t["text"]) for t in r["read"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        runs = sum(k == 0 or own[k][0] != own[k - 1][0] for k in range(len(own)))
        assert r["formatted"].count("<|end|>\n") == runs
        for s in r["loss_spans"]:
            assert "<|" not in r["formatted"][s["start"] : s["stop"]]


def test_odd_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 0, "user", None), (1, None, None, "first"), (1, 2, "assistant", ""), (1, 2, "assistant", "tie"), (None, 0, "assistant", "x"), (2, 0, "user", "w " * 300_000), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    got = {r["conv_id"]: r for r in formatted(df).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["read"]] == [("", "first"), ("user", ""), ("user", "b"), ("assistant", ""), ("assistant", "tie")]
    assert got[1]["loss"] == "tie" and got[None]["loss"] == "x" and len(got[3]["read"]) == 2 and got[2]["loss_spans"] == []
    assert formatted(df.filter("false")).count() == 0


def test_begins_of_many_parts(spark):
    rng = random.Random(4)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 511, 512, 513, 3000)]
    for r in spark.createDataFrame(rows, "n int, lengths array<long>").select("lengths", chat_format.begins(F.col("lengths")).alias("at")).collect():
        assert r["at"] == [sum(r["lengths"][:k]) for k in range(len(r["lengths"]))]
