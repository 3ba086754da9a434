"""The enrichment query over any pair of kinds: what goes with x, given groups that hold x."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.operators import names, select
from coclave.operators.enrich import enrichment
from coclave.sources.star import Star


#: How enrichment comes sorted: the most significant first, at a tie the rarer, then by key.
ORDER = ["pval", "counts", "key"]


def selected_groups(model: Star, x: list, kind: str, logic: str) -> DataFrame:
    """cluster_id of the groups chosen by x."""
    groups = model.biclusters.select("cluster_id")
    if kind == "row":
        return select.members(groups, model.bc_rows, "row_id", x, logic)
    if kind == "col":
        return select.members(groups, model.bc_cols, "col_id", x, logic)
    if kind == "gre":
        return groups.join(select.scalar(model.motifs.filter("gre_id is not null"), "gre_id", x, logic).select("cluster_id"), "cluster_id", "left_semi")
    return select.scalar(groups, "cluster_id", x, logic)


def agglom(model: Star, x: list | str | int, x_type: str, y_type: str = "cluster", x_input_type: str | None = None, y_output_type: str | None = None, logic: str = "or", gre_lim: int = 10, pval_cutoff: float = 0.05) -> DataFrame:
    """Enrichment of y in the groups chosen by x; for y 'cluster' the groups themselves with their size and member names.

    x may be ids, or names in the field x_input_type. y_output_type names the field that keys are written in. Rows are sorted by
    p-value, counts and key; groups by their size, the largest first.
    """
    x = [x] if isinstance(x, str | int) else list(x)
    x_kind, y_kind = select.kind_of(x_type), select.kind_of(y_type)
    info = {"row": (model.row_info, "row_id"), "col": (model.col_info, "col_id")}
    if x_input_type and x_kind in info:
        table, key = info[x_kind]
        x = [r[key] for r in names.by_field(table, x, x_input_type, key).orderBy("pos").collect()]
    if not x:
        raise ValueError("nothing to look for")
    chosen = selected_groups(model, x, x_kind, logic)
    if y_kind == "cluster":
        named = model.bc_rows.join(chosen, "cluster_id", "left_semi").join(model.row_info, "row_id")
        sized = named.groupBy("cluster_id").agg(F.count("*").alias("num_genes"), F.array_sort(F.collect_list("sys_name")).alias("genes"))
        return sized.orderBy(F.col("num_genes").desc(), "cluster_id")
    if y_kind == "gre":
        bridge = model.motifs.filter("gre_id is not null").select("cluster_id", "gre_id")
        return enrichment(bridge, "gre_id", chosen, model.biclusters, drawn_rows=True, least=gre_lim, cutoff=pval_cutoff).orderBy(*ORDER)
    table, key = info[y_kind]
    bridge = model.bc_rows if y_kind == "row" else model.bc_cols
    done = enrichment(bridge, key, chosen, model.biclusters, known=table.select(key), cutoff=pval_cutoff)
    if y_output_type:
        done = done.join(table.select(F.col(key).alias("key"), F.col(y_output_type).alias("name")), "key").drop("key").withColumnRenamed("name", "key")
    return done.orderBy(*ORDER)
