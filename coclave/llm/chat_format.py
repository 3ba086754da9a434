"""Chat formatting with Spark expressions only.

A conversation becomes one string. A run of adjacent turns of one role is one block:

    <|role|>\\n text <|sep|> text ... <|end|>\\n

Inside roles and texts a backslash is doubled and the strings in CONTROL get a backslash after their first character, so that no
control string survives and every text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that templates use to mark turns.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE, SEP, END = "<|", "|>\n", "<|sep|>", "<|end|>\n"
#: Parts whose running sums are appended one after another.
CHUNK = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def begins(lengths: Column) -> Column:
    """Where each part begins, of parts of these lengths laid end to end.

    Running sums are appended within chunks and over the chunks, so what is copied grows with CHUNK times the parts, and with the
    square of the number of chunks, not of parts.
    """
    sums = lambda of: F.aggregate(of, F.array(F.lit(0).cast("long")), lambda acc, n: F.array_append(acc, F.get(acc, F.size(acc) - 1) + n))
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    inner = F.transform(numbers, lambda c: sums(F.slice(lengths, c * CHUNK + 1, CHUNK)))
    whole = F.struct(inner.alias("inner"), sums(F.transform(inner, lambda e: F.element_at(e, -1))).alias("before"))
    laid = lambda w: F.flatten(F.transform(w["inner"], lambda e, c: F.transform(F.slice(e, 1, F.size(e) - 1), lambda x: x + F.get(w["before"], c))))
    return F.when(F.size(lengths) > 0, F.get(F.transform(F.array(whole), laid), F.lit(0))).otherwise(F.array().cast("array<long>"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant"
) -> DataFrame:
    """One row per conversation: (conv, formatted string, loss_spans array<struct<start long, stop long>>).

    Rows are ordered by turn (null first), then role, then text, so ties have one result and repeated rows are kept. Null roles
    and texts count as empty. Spans are half-open, in code points of `formatted`; there is one for each turn of `train_on`.
    A null conversation key is a conversation of its own; an empty table gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("__conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    listed = rows.groupBy("__conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Where a run of one role starts; the run's turns are the slice up to the next start.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    blocks = listed.withColumn("starts", starts).withColumn(
        "runs",
        F.transform(
            "starts",
            lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
        ),
    )
    blocks = blocks.withColumn(
        "runs",
        F.transform(
            "runs",
            lambda run: F.struct(
                F.get(run, F.lit(0))["role"].alias("role"),
                F.transform(run, lambda t: escape(t["text"])).alias("texts"),
            ),
        ),
    ).withColumn(
        "blocks",
        F.transform(
            "runs",
            lambda run: F.concat(F.lit(OPEN), escape(run["role"]), F.lit(CLOSE), F.array_join(run["texts"], SEP), F.lit(END)),
        ),
    )
    blocks = blocks.withColumn("begins", begins(F.transform("blocks", lambda b: F.length(b).cast("long"))))
    spans = F.flatten(
        F.transform(
            "runs",
            lambda run, k: F.when(
                run["role"] == train_on,
                F.transform(
                    F.arrays_zip(
                        run["texts"].alias("t"),
                        begins(F.transform(run["texts"], lambda t: (F.length(t) + len(SEP)).cast("long"))).alias("at"),
                    ),
                    lambda x: F.struct(
                        (F.get("begins", k) + len(OPEN) + F.length(escape(run["role"])) + len(CLOSE) + x["at"]).alias("start"),
                        (F.get("begins", k) + len(OPEN) + F.length(escape(run["role"])) + len(CLOSE) + x["at"] + F.length(x["t"])).alias("stop"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>")),
        )
    )
    return blocks.select(
        F.col("__conv").alias(conv),
        F.array_join("blocks", "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string, merged ones apart again."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.position(F.lit(CLOSE), b) + len(CLOSE)), r"<\|sep\|>"),
                lambda t: F.struct(
                    unescape(F.substr(b, F.lit(len(OPEN) + 1), F.position(F.lit(CLOSE), b) - 1 - len(OPEN))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, read back and joined with nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))),
        ),
        "",
    )
