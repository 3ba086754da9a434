"""From memberships to corems with the conditions that they are tight in: the whole assembly as one chain of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.functions.stats import rsd
from coclave.operators import communities, graph, resample
from coclave.runtime import cut


@dataclass(frozen=True)
class Assembly:
    edges: DataFrame
    densities: DataFrame
    corem_edges: DataFrame
    corem_rows: DataFrame
    corem_cols: DataFrame


def assemble(bc_rows: DataFrame, cells: DataFrame, cutoff: float = 0.05, thresholds: list[float] | None = None, definition: int = 0, option: int = 5, least_edges: int = 3, resamples: int = 1000, keep: float = 0.1, significance: float = 0.05) -> Assembly:
    """Graph, backbone, link communities at the best threshold, and per corem the columns of low relative deviation."""
    thresholds = thresholds or communities.THRESHOLDS
    edges = cut(graph.backbone(graph.backbone_pval(graph.weigh(graph.cooccurrence(bc_rows))), cutoff))
    labelled = cut(communities.link_communities(edges, graph.edge_links(edges, definition, min(thresholds)), thresholds))
    densities = cut(communities.partition_densities(communities.community_stats(labelled)))
    best = communities.best_threshold(densities, option)
    kept = cut(communities.corems(labelled.join(F.broadcast(best.select("threshold")), "threshold", "left_semi"), least_edges))
    held = communities.corem_rows(kept)
    return Assembly(edges, densities, kept, held, corem_columns(held, cells, resamples, keep, significance))


def corem_columns(held: DataFrame, cells: DataFrame, resamples: int, keep: float, significance: float) -> DataFrame:
    """(corem_id, col_id, pval): each corem's columns against nulls of its own size, all sizes from one sequence of draws."""
    sizes = cut(held.groupBy("corem_id").agg(F.count("*").alias("nrows")))
    asked = [r["nrows"] for r in sizes.select("nrows").distinct().collect()]
    if not asked:
        return held.sparkSession.createDataFrame([], "corem_id int, col_id long, pval double")
    nulls = resample.lowest_of_sizes(cells, asked, resamples, keep)
    seen = held.join(cells, "row_id").groupBy("corem_id", "col_id").agg(rsd(F.col("raw")).alias("rsd")).join(sizes, "corem_id")
    key = F.struct("col_id", "nrows")
    tested = resample.empirical_pvalue(seen.select("corem_id", key.alias("key"), "rsd"), nulls.select(key.alias("key"), "resamples", "lowest"), cutoff=significance, col="key", also=["corem_id"])
    return tested.select("corem_id", "key.col_id", "pval")
