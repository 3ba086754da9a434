"""Consecutive numbers without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.runtime import cut

_WITHIN = (1 << 33) - 1


def _placed(df: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """(rows that keep their places, with __part and __at within it; rows before each part; all rows)."""
    line = cut(df).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(_WITHIN))
    offsets, before = [], 0
    for part, n in sorted((r["__part"], r["count"]) for r in line.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    return line, offsets, before


def in_place(df: DataFrame, out: str, start: int = 0) -> DataFrame:
    """Adds `out`, the row's number from `start` on, in the order of partitions and of rows in them.

    The rows are cut first, so that they keep their places; a count per partition comes to the driver.
    """
    line, offsets, _ = _placed(df)
    # A row per partition.
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __start long"))
    return line.join(starts, "__part").withColumn(out, F.col("__start") + F.col("__at") + start).drop("__part", "__at", "__start")


def least_from_here(df: DataFrame, order: list[str | Column], value: Callable[[Column, Column], Column], out: str, all_rows: str) -> DataFrame:
    """Adds `all_rows`, their number, and `out`, the least of value(number from 1, all rows) over the row and those after it in the order of these columns.

    Each range of the order is gone through by itself; what the ranges after it have at least is one number a range, which comes
    to the driver and back.
    """
    # Cut before the sort too, whose ranges take a first look at the rows.
    line, offsets, total = _placed(cut(df).orderBy(*order))
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "__part int, __start long"))
    own = line.join(starts, "__part").withColumn("__at", F.col("__start") + F.col("__at") + 1).withColumn("__value", value(F.col("__at"), F.lit(total)))
    after, least = [], None
    for r in sorted(own.groupBy("__part").agg(F.min("__value").cast("double").alias("least")).collect(), reverse=True):
        after.append((r["__part"], least))
        least = r["least"] if least is None else least if r["least"] is None else min(least, r["least"])
    behind = F.broadcast(spark.createDataFrame(after, "__part int, __after double"))
    back = Window.partitionBy("__part").orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = own.join(behind, "__part").withColumn(out, F.least(F.min("__value").over(back), F.col("__after"))).withColumn(all_rows, F.lit(total))
    return done.drop("__part", "__at", "__start", "__value", "__after")


def in_order(df: DataFrame, order: list[str | Column], out: str, start: int = 0) -> DataFrame:
    """Adds `out`, the row's number from `start` on in the order of these columns, which must tell rows apart."""
    return in_place(df.orderBy(*order), out, start)
