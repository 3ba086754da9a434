"""Membership selections over a bridge table (group, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that a caller may use for the kinds of things in the model.
ALIASES = {
    "row": {"row", "rows", "gene", "genes"},
    "col": {"col", "cols", "column", "columns", "cond", "conds", "condition", "conditions"},
    "gre": {"gre", "gres", "gre_id", "motif", "motifs", "motif_id"},
    "cluster": {"_id", "bc", "bcs", "bicluster", "biclusters", "cluster", "clusters"},
}


def kind_of(name: str) -> str:
    """The canonical kind; ValueError for an unknown name."""
    for kind, names in ALIASES.items():
        if name.lower() in names:
            return kind
    raise ValueError(f"unknown type {name!r}")


def members(groups: DataFrame, bridge: DataFrame, member: str, wanted: list, logic: str, group: str = "cluster_id") -> DataFrame:
    """The rows of `groups` that hold any (or), all (and) or none (nor) of `wanted`.

    The bridge is filtered before it is joined; `and` counts distinct members, so repeats in `wanted` or the bridge do not matter.
    """
    hit = bridge.filter(F.col(member).isin(list(dict.fromkeys(wanted)))).select(group, member)
    if logic == "or":
        return groups.join(hit.select(group), group, "left_semi")
    if logic == "nor":
        return groups.join(hit.select(group), group, "left_anti")
    if logic == "and":
        all_of = hit.groupBy(group).agg(F.count_distinct(member).alias("n")).filter(F.col("n") == len(set(wanted))).select(group)
        return groups.join(all_of, group, "left_semi")
    raise ValueError("logic must be 'and', 'or' or 'nor'")


def scalar(df: DataFrame, column: str, wanted: list, logic: str) -> DataFrame:
    """The same over a plain column: `and` of two different values holds nowhere, `nor` keeps the other values."""
    found = F.col(column).isin(list(wanted))
    if logic == "and":
        return df.filter(found) if len(set(wanted)) == 1 else df.filter(F.lit(False))
    if logic not in ("or", "nor"):
        raise ValueError("logic must be 'and', 'or' or 'nor'")
    return df.filter(found if logic == "or" else ~found)


def by_composed_name(df: DataFrame, names: list[str], fields: list[str], sep: str = "_") -> DataFrame:
    """Rows that match any of names such as "3_10_1", read as the values of `fields`; sep splits from the left."""
    condition = F.lit(False)
    for name in names:
        values = name.split(sep)
        if len(values) != len(fields):
            raise ValueError(f"{name!r} does not name {fields}")
        one = F.lit(True)
        for f, v in zip(fields, values, strict=True):
            one &= F.col(f).cast("string") == v
        condition |= one
    return df.filter(condition)


def first_match_column(df: DataFrame, columns: list[str], order: str, value: object) -> DataFrame:
    """The name of the first column, in the first row by `order`, that holds the value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    found = F.get(F.filter(pairs, lambda p: p["value"] == F.lit(str(value))), F.lit(0))["column"]
    return df.select(F.col(order), found.alias("column")).filter("column is not null").orderBy(order).limit(1)


def has_annotation(df: DataFrame, notes: str, name: str, value: str | None = None, regex: str | None = None) -> DataFrame:
    """Rows of which one element of the array has this name and value, or a value that the pattern finds."""
    test = lambda e: (e["name"] == name) & (e["value"] == value if regex is None else e["value"].rlike(regex))
    return df.filter(F.exists(notes, test))
