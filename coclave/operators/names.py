"""Names to ids and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _wanted(df: DataFrame, names: list) -> DataFrame:
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(str(n)) for n in names))).alias("pos", "wanted"))
    return listed


def by_any_field(info: DataFrame, names: list, fields: list[str], distinct: bool = True) -> DataFrame:
    """Rows of info of which any field has one of the names. With distinct, each row once; else once per matching field and name."""
    if distinct:
        match = F.lit(False)
        for f in fields:
            match |= F.col(f).cast("string").isin([str(n) for n in names])
        return info.filter(match).distinct()
    pairs = info.select("*", F.explode(F.array(*(F.col(f).cast("string") for f in fields))).alias("__name"))
    return pairs.filter(F.col("__name").isin([str(n) for n in names])).drop("__name")


def by_field(info: DataFrame, names: list, field: str, out: str, distinct: bool = True, check: bool = True) -> DataFrame:
    """(pos, out): values of `out` for names of `field`, numbered in input order; a repeated value keeps its first place.

    With check, a name that info does not have is an error, as is asking a field for itself.
    """
    if field == out:
        raise ValueError("input and output field are the same")
    wanted = _wanted(info, names)
    joined = F.broadcast(wanted).join(info.select(F.col(field).cast("string").alias("wanted"), F.col(out).alias("__out")), "wanted", "left")
    if check:
        missing = [r["wanted"] for r in joined.filter(F.col("__out").isNull()).select("wanted").distinct().limit(5).collect()]
        if missing:
            raise KeyError(f"not in {field}: {missing}")
    found = joined.filter(F.col("__out").isNotNull()).select("pos", F.col("__out").alias(out))
    found = found.groupBy(out).agg(F.min("pos").alias("pos")) if distinct else found
    return found.select("pos", out)


def keep_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, where it first stands."""
    rank = F.row_number().over(Window.partitionBy(value).orderBy(order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
