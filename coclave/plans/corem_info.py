"""What corems hold, asked by any of their parts: corems, rows, columns or edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.operators import corem, names
from coclave.operators.select import kind_of

#: Names that a caller may use for corems and edges; those of rows and columns are in select.ALIASES.
COREMS, EDGES = {"corem", "corems", "corem_id"}, {"edge", "edges"}


@dataclass(frozen=True)
class Corems:
    """edges: (corem_id, a, b), rows: (corem_id, row_id), cols: (corem_id, col_id), and the names of rows and columns."""

    edges: DataFrame
    rows: DataFrame
    cols: DataFrame
    row_info: DataFrame
    col_info: DataFrame


def corem_kind(name: str) -> str:
    """corem, edge, row or col; ValueError for any other."""
    low = name.lower()
    kind = "corem" if low in COREMS else "edge" if low in EDGES else kind_of(low)
    if kind not in ("corem", "edge", "row", "col"):
        raise ValueError(f"corems have no {name!r}")
    return kind


def _ids(info: DataFrame, given: list, fields: list[str], key: str) -> list:
    """Ids of the names, in any of the fields; KeyError if there is none. As long as what the caller gives."""
    found = [r[key] for r in names.by_any_field(info, given, fields).select(key).distinct().orderBy(key).collect()]
    if not found:
        raise KeyError(f"none of {given} is known")
    return found


def corem_info(of: Corems, x: list | str | int, x_type: str = "corem_id", y_type: str = "genes", x_field: str | None = None, y_field: str | None = None, count: bool = False, logic: str = "or") -> DataFrame:
    """(y_type[, counts]) of the corems that hold any, all or none of x, sorted.

    Rows and columns are given by id or name, in x_field or in any field, edges as "a-b" in either order of their ends, and written as
    y_field. With several corems chosen and `and`, only what all of them hold; counts are over the chosen corems.
    """
    x = [x] if isinstance(x, str | int) else list(x)
    x_kind, y_kind = corem_kind(x_type), corem_kind(y_type)
    info = {"row": (of.row_info, "row_id", ["row_id", "name", "sys_name"]), "col": (of.col_info, "col_id", ["col_id", "name"])}
    keyed = of.edges.select("corem_id", "a", "b", corem.edge_key(F.col("a"), F.col("b")).alias("edge"))
    if x_kind == "corem":
        chosen = corem.choose(of.rows, of.rows, "corem_id", x, logic)
    elif x_kind == "edge":
        table, key, fields = info["row"]
        ends = [[_ids(table, [end], [x_field] if x_field else fields, key)[0] for end in edge.split("-")] for edge in x]
        chosen = corem.choose(of.rows, keyed, "edge", [f"{min(e)}-{max(e)}" for e in ends], logic)
    else:
        table, key, fields = info[x_kind]
        chosen = corem.choose(of.rows, of.rows if x_kind == "row" else of.cols, key, _ids(table, x, [x_field] if x_field else fields, key), logic)
    if y_kind == "corem":
        return chosen.select(F.col("corem_id").alias(y_type)).orderBy(y_type)
    if y_kind == "edge":
        named = corem.edge_names(keyed.join(chosen, "corem_id", "left_semi"), of.row_info, y_field or "sys_name")
        return named.select(F.col("edge").alias(y_type)).orderBy(y_type)
    table, key, _ = info[y_kind]
    held = corem.shared(of.rows if y_kind == "row" else of.cols, key, chosen, logic)
    named = held.join(table.select(key, F.col(y_field or ("sys_name" if y_kind == "row" else "name")).alias(y_type)), key)
    return named.select(y_type, "counts").orderBy(F.col("counts").desc(), y_type) if count else named.select(y_type).distinct().orderBy(y_type)
