"""What corems hold: lookups between corems, rows, columns and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.operators.select import members, scalar


def with_genes(corem_rows: DataFrame, info: DataFrame, names: list[str], field: str = "sys_name") -> DataFrame:
    """(corem_id, gene) for every corem that holds one of the named rows."""
    return corem_rows.join(info.filter(F.col(field).isin(names)).select("row_id", F.col(field).alias("gene")), "row_id").select("corem_id", "gene")


def genes_of(corem_rows: DataFrame, info: DataFrame, corem_id: int, field: str = "sys_name") -> DataFrame:
    return corem_rows.filter(F.col("corem_id") == corem_id).join(info, "row_id").select(F.col(field).alias("gene"))


def sharing_rows(corem_rows: DataFrame, info: DataFrame, corem_id: int, field: str = "sys_name") -> DataFrame:
    """(corem_id, gene) of every corem and every row of it that the given corem holds too."""
    own = corem_rows.filter(F.col("corem_id") == corem_id).select("row_id")
    return corem_rows.join(own, "row_id", "left_semi").join(info.select("row_id", F.col(field).alias("gene")), "row_id").select("corem_id", "gene")


def edge_key(a: Column, b: Column) -> Column:
    """An edge as text, the same for both orders of its ends."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def choose(corem_rows: DataFrame, bridge: DataFrame, member: str, wanted: list, logic: str) -> DataFrame:
    """corem_id of the corems that hold any, all or none of the wanted members."""
    every = corem_rows.select("corem_id").distinct()
    if member == "corem_id":
        return scalar(every, "corem_id", wanted, "or" if logic == "and" else logic)
    return members(every, bridge, member, wanted, logic, "corem_id")


def shared(bridge: DataFrame, member: str, chosen: DataFrame, logic: str = "or") -> DataFrame:
    """(member, counts): members of the chosen corems; with `and` only those in all of them."""
    inside = bridge.join(chosen, "corem_id", "left_semi").groupBy(member).agg(F.count("*").alias("counts"))
    if logic == "and":
        return inside.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("__n")))).filter("counts >= __n").drop("__n")
    return inside


def edge_names(corem_edges: DataFrame, info: DataFrame, field: str = "sys_name", sep: str = "-") -> DataFrame:
    """(corem_id, edge) with the ends by name, as they are ordered by id."""
    x, y = (info.select(F.col("row_id").alias(end), F.col(field).alias(f"name_{end}")) for end in ("a", "b"))
    return corem_edges.join(x, "a").join(y, "b").select("corem_id", F.concat_ws(sep, "name_a", "name_b").alias("edge"))


def sizes(corem_rows: DataFrame) -> DataFrame:
    """The distinct numbers of rows that corems have, ascending."""
    return corem_rows.groupBy("corem_id").agg(F.count("row_id").alias("size")).select("size").distinct().orderBy("size")
