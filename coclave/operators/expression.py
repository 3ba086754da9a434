"""Long-form matrices: (row, column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.functions.stats import percentiles, rsd


def zscore(cells: DataFrame, row: str = "row_id", value: str = "raw", out: str = "std") -> DataFrame:
    """Adds (value - mean) / sample deviation of the row; null where a row has fewer than two values or none differ."""
    by = Window.partitionBy(row)
    return cells.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(by), F.stddev_samp(value).over(by)))


def median_scale(cells: DataFrame, row: str = "row_id", value: str = "raw", out: str = "scaled", digits: int = 8) -> DataFrame:
    """Adds (value - median) / sample deviation, the deviation rounded; null where that is 0 or null."""
    stats = cells.groupBy(row).agg(F.median(value).alias("__m"), F.round(F.stddev_samp(value), digits).alias("__s"))
    return cells.join(stats, row).withColumn(out, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def drop_unchanging(cells: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "raw", near: float = 0.17, row_share: float = 0.98, col_share: float = 0.1) -> DataFrame:
    """Cells of rows and columns of which a small enough share is missing or within `near` of 0; both on the original matrix.

    Cells that are not there count as missing, so shares are over the other side's distinct keys.
    """
    still = F.sum(F.when(F.coalesce(F.abs(value) <= near, F.lit(True)) | F.isnan(value), 0).otherwise(1))
    n = cells.agg(F.count_distinct(row).alias("n_rows"), F.count_distinct(col).alias("n_cols"))
    rows = cells.groupBy(row).agg(still.alias("moved")).crossJoin(F.broadcast(n)).filter(1 - F.col("moved") / F.col("n_cols") < row_share).select(row)
    cols = cells.groupBy(col).agg(still.alias("moved")).crossJoin(F.broadcast(n)).filter(1 - F.col("moved") / F.col("n_rows") < col_share).select(col)
    return cells.join(rows, row, "left_semi").join(cols, col, "left_semi")


def rsd_by_column(cells: DataFrame, rows: list, cols: list | None = None, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """(column, rsd) of the given rows."""
    picked = cells.filter(F.col(row).isin(rows))
    picked = picked if cols is None else picked.filter(F.col(col).isin(cols))
    return picked.groupBy(col).agg(rsd(F.col(value)).alias("rsd"))


def slice_wide(cells: DataFrame, rows: list, cols: list, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """The chosen rows by the chosen columns, sorted; cells that are not there are null."""
    picked = cells.filter(F.col(row).isin(rows) & F.col(col).isin(cols))
    wide = picked.groupBy(row).pivot(col, sorted(cols)).agg(F.first(value))
    return wide.select(row, *(F.col(f"`{c}`").alias(f"c{c}") for c in sorted(cols))).orderBy(row)


def to_long(wide: DataFrame, row: str, out_col: str = "col", out_value: str = "value") -> DataFrame:
    return wide.unpivot([row], [c for c in wide.columns if c != row], out_col, out_value)


def limits(cells: DataFrame, value: str = "raw", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(low, high) exact percentiles; symmetric about 0 if the lower is below 0."""
    a, b = percentiles(cells, value, [low, high])
    if a is not None and a < 0:
        a, b = -max(abs(a), abs(b)), max(abs(a), abs(b))
    return cells.sparkSession.createDataFrame([(a, b)], "low double, high double")


def columns_by_mean(cells: DataFrame, col: str = "col_id", value: str = "raw") -> DataFrame:
    return cells.groupBy(col).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc(), col)


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null, so that aggregates skip it."""
    fixed: dict[str, Column] = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    return df.withColumns(fixed)
