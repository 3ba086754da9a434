"""Link communities: single linkage of edges by similarity, their densities, and the export of the best cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.operators.components import components
from coclave.operators.number import in_order

#: The cuts of a whole sweep.
THRESHOLDS = [k / 10 for k in range(1, 11)]
#: The density that each option picks.
DENSITY_OF_OPTION = {1: "d1", 2: "d2", 3: "d3", 4: "d4", 5: "d5"}


def _numbered(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """An id for every (threshold, edge): thresholds never share an id, so one run of components serves all."""
    ranked = in_order(edges, ["a", "b"], "edge")
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds))))
    return ranked.withColumn("t", listed).select("a", "b", "weight", "edge", F.col("t.threshold").alias("threshold"), (F.col("edge") * len(thresholds) + F.col("t.k")).alias("id"))


def link_communities(edges: DataFrame, similarity: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, a, b, weight, community): edges joined by chains of pairs with that similarity or more.

    `similarity` is (keystone, i, j, similarity). A community is numbered by its first edge in order of (a, b).
    """
    named = _numbered(edges, thresholds)
    of = lambda x, y, out: (F.least(x, y).alias(f"{out}_a"), F.greatest(x, y).alias(f"{out}_b"))
    pairs = similarity.filter(F.col("similarity") >= min(thresholds)).select(*of("keystone", "i", "x"), *of("keystone", "j", "y"), "similarity")
    x = named.select(F.col("a").alias("x_a"), F.col("b").alias("x_b"), F.col("id").alias("src"), "threshold")
    y = named.select(F.col("a").alias("y_a"), F.col("b").alias("y_b"), F.col("id").alias("dst"), "threshold")
    links = pairs.join(x, ["x_a", "x_b"]).filter(F.col("similarity") >= F.col("threshold")).join(y, ["y_a", "y_b", "threshold"])
    found = components(links.select("src", "dst"))
    labelled = named.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    return labelled.select("threshold", "a", "b", "weight", F.expr(f"label div {len(thresholds)}").alias("community"))


def community_stats(labelled: DataFrame) -> DataFrame:
    """(threshold, community, m edges, n nodes, w weight)."""
    ends = labelled.select("threshold", "community", "weight", F.explode(F.array("a", "b")).alias("node"), F.col("a"), F.col("b"))
    return ends.groupBy("threshold", "community").agg((F.count("*") / 2).cast("long").alias("m"), F.count_distinct("node").alias("n"), (F.sum("weight") / 2).alias("w"))


def partition_densities(stats: DataFrame) -> DataFrame:
    """One row per threshold: edges, communities, and the five partition densities; null where nothing is there to divide by."""
    m, n, w = F.col("m"), F.col("n"), F.col("w")
    f = F.when(n > 2, (m - (n - 1)) / ((n - 2) * (n - 1))).otherwise(0.0)
    total = lambda x: F.sum(x)
    sums = stats.groupBy("threshold").agg(
        total(m).alias("edges"), total(F.when(n != 2, m).otherwise(0)).alias("edges_ns"), total(w).alias("weight"), F.count("*").alias("communities"),
        total(m * f).alias("mf"), total(w * w / m * f).alias("wwf"), total(w * f).alias("wf"),
    )
    two = lambda top, bottom: F.try_divide(2 * F.col(top), F.col(bottom))
    return sums.select(
        "threshold", "edges", "edges_ns", "communities",
        two("mf", "edges").alias("d1"), two("mf", "edges_ns").alias("d2"), two("wf", "weight").alias("d3"), two("wf", "edges").alias("d4"), two("wwf", "weight").alias("d5"),
    )


def best_threshold(densities: DataFrame, option: int = 5) -> DataFrame:
    """The first threshold with the largest density of the option; densities equal to 12 places tie, as sums depend on order."""
    d = DENSITY_OF_OPTION[option]
    return densities.orderBy(F.round(d, 12).desc_nulls_last(), "threshold").limit(1).select("threshold", F.col(d).alias("density"))


def at_best(labelled: DataFrame, option: int = 5) -> DataFrame:
    """The rows of link_communities of the best threshold."""
    best = best_threshold(partition_densities(community_stats(labelled)), option)
    return labelled.join(F.broadcast(best.select("threshold")), "threshold", "left_semi")


def corems(labelled: DataFrame, least_edges: int = 3) -> DataFrame:
    """(corem_id, a, b, weight, density, weighted_density): communities of enough edges and some density, densest first.

    Of one threshold. Densities have 5 places. Numbers go by density, weighted density and community, all descending.
    """
    m, n = F.col("m"), F.col("n")
    density = F.when(n == 2, 0.0).otherwise(F.try_divide(m - n + 1, n * (n - 1) / 2 - n + 1))
    stats = community_stats(labelled).withColumn("raw", density).withColumn("density", F.round("raw", 5))
    stats = stats.withColumn("weighted_density", F.round(F.round(F.col("w") / m, 5) * F.col("raw"), 5)).filter((m >= least_edges) & (F.col("density") > 0))
    order = [F.col("density").desc(), F.col("weighted_density").desc(), F.col("community").desc(), F.col("threshold")]
    ranked = in_order(stats, order, "corem_id", 1).withColumn("corem_id", F.col("corem_id").cast("int")).select("threshold", "community", "corem_id", "density", "weighted_density")
    return labelled.join(ranked, ["threshold", "community"]).select("corem_id", "a", "b", "weight", "density", "weighted_density")


def corem_rows(corem_edges: DataFrame) -> DataFrame:
    """(corem_id, row_id), each once."""
    return corem_edges.select("corem_id", F.explode(F.array("a", "b")).alias("row_id")).distinct()


def corem_lists(corem_rows: DataFrame) -> DataFrame:
    """(corem_id, rows): the rows of each corem as one ascending array."""
    return corem_rows.groupBy("corem_id").agg(F.array_sort(F.collect_set("row_id")).alias("rows"))
