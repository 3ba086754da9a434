"""Weighted co-occurrence graphs, their backbone, and similarity of adjacent edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.operators.number import in_order
from coclave.runtime import PER_TASK, cut, dealt

#: How many times the pairs of a task one group may make before its join is left to Spark's splitting of large partitions.
HOT = 64


def counted_pairs(bridge: DataFrame, member: str = "row_id", group: str = "cluster_id", mirrored: bool = False) -> DataFrame:
    """(src, dst, counts): how many groups hold both, each pair once with src < dst, or in both directions; repeated rows count once.

    One self-join on the group, its pairs dealt out by src and counted there. The work is the sum of squared group sizes; a group is
    a cluster of rows, so its size does not grow with the number of groups. Tasks get a bounded number of rows and of pairs. Should
    the pairs of one group be more than that many times over, Spark's own partitions serve the join, as it can split these.
    """
    rows = bridge.count()
    named = bridge.select(F.col(group).alias("group"), F.col(member).alias("member")).filter("group is not null and member is not null")
    sizes = dealt(named, rows, "group").distinct().groupBy("group").agg(F.count("*").alias("n"))
    made = F.col("n").cast("double") * (F.col("n") - 1) / (1 if mirrored else 2)
    total, most = sizes.agg(F.coalesce(F.sum(made), F.lit(0.0)), F.coalesce(F.max(made), F.lit(0.0))).first()
    held = (dealt(named, max(rows, total), "group") if most <= HOT * PER_TASK else named).distinct()
    a, b = held.withColumnRenamed("member", "src"), held.withColumnRenamed("member", "dst")
    met = a.join(b, "group").filter("src <> dst" if mirrored else "src < dst").select("src", "dst")
    return dealt(met, total, "src").groupBy("src", "dst").agg(F.count("*").alias("counts"))


def cooccurrence(bridge: DataFrame, member: str = "row_id", group: str = "cluster_id") -> DataFrame:
    """(src, dst, counts): how many groups hold both, each pair in both directions."""
    return counted_pairs(bridge, member, group, mirrored=True)


def weigh(edges: DataFrame) -> DataFrame:
    """Adds weight, the share of src's counts, and degree, the number of its neighbours."""
    by = Window.partitionBy("src")
    return edges.filter("src <> dst and counts > 0").withColumn("weight", F.col("counts") / F.sum("counts").over(by)).withColumn("degree", F.count("*").over(by))


def backbone_pval(weighted: DataFrame) -> DataFrame:
    """Adds pval, the disparity filter's (1 - weight)^(degree - 1): 1 for an only neighbour."""
    return weighted.withColumn("pval", F.pow(1 - F.col("weight"), (F.col("degree") - 1).cast("double")))


def backbone(scored: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """(a, b, weight), a < b: pairs of which either direction is significant, with the larger significant weight."""
    kept = scored.filter(F.col("pval") <= cutoff)
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def adjacency(edges: DataFrame, inclusive: int | None = None) -> DataFrame:
    """(node, other, w) in both directions; inclusive 0 adds each node itself with its mean weight, 1 with weight 1."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("weight").alias("w")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("weight").alias("w"))
    )
    if inclusive is None:
        return both
    own = both.groupBy("node").agg((F.avg("w") if inclusive == 0 else F.lit(1.0)).alias("w")).select("node", F.col("node").alias("other"), "w")
    return both.unionByName(own)


def wedges(edges: DataFrame) -> DataFrame:
    """(keystone, i, j), i < j: pairs of edges that share the node keystone."""
    near = adjacency(edges).select(F.col("node").alias("keystone"), "other")
    a, b = near.withColumnRenamed("other", "i"), near.withColumnRenamed("other", "j")
    return a.join(b, "keystone").filter("i < j")


def inner_products(edges: DataFrame, definition: int = 0) -> DataFrame:
    """(i, j, dot), i <= j: inner products of inclusive neighbourhoods, only of pairs that share a neighbour."""
    near = adjacency(edges, definition).select(F.col("other").alias("via"), "node", "w")
    a, b = near.select("via", F.col("node").alias("i"), F.col("w").alias("wi")), near.select("via", F.col("node").alias("j"), F.col("w").alias("wj"))
    return a.join(b, "via").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"))


def least_norm_ratio(least: float) -> float:
    """The least ratio of two norms whose Tanimoto coefficient, rounded to 5 places, can reach `least`.

    A dot product is at most the product of the norms, so with their ratio r the coefficient is at most r / (1 + r^2 - r).
    """
    t = min(least, 1.0) - 1e-5
    return 0.0 if t <= 0 else ((1 + t) - math.sqrt(max(0.0, (1 + t) ** 2 - 4 * t * t))) / (2 * t)


def tanimoto(dot: Column, one: Column, two: Column) -> Column:
    return F.round(dot / (one + two - dot), 5)


def similar_nodes(near: DataFrame, least: float, leaf_pairs: bool) -> DataFrame:
    """(i, j, similarity), i < j, of the nodes of inclusive neighbourhoods (via, node, w, leaf) that reach `least`.

    Nodes meet at a common neighbour and a band of norms; bands are as wide as the ratio that `least` still allows, so only the same
    and the next ones meet, and a hub's neighbours are split by their norms. Without `leaf_pairs` leaves do not meet each other.
    """
    norms = near.groupBy("node").agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    ratio = least_norm_ratio(least)
    band = F.floor(F.log(F.sqrt("norm")) / -math.log(min(ratio, 1 - 1e-9))) if ratio > 0 else F.lit(0).cast("long")
    placed = near.join(norms.withColumn("band", band), "node")
    a = placed.select("via", "band", F.col("node").alias("x"), F.col("w").alias("wx"), F.col("norm").alias("nx"), F.col("leaf").alias("x_leaf"))
    b = placed.select("via", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1) if ratio > 0 else F.array("band")).alias("band"), F.col("node").alias("y"), F.col("w").alias("wy"), F.col("norm").alias("ny"), F.col("leaf").alias("y_leaf"))
    # Two of a kind meet once, in order; a leaf is met by what is none.
    met = a.filter("not x_leaf").join(b, ["via", "band"]).filter("(y_leaf and x <> y) or (not y_leaf and x < y)")
    if leaf_pairs:
        met = met.unionByName(a.filter("x_leaf").join(b.filter("y_leaf"), ["via", "band"]).filter("x < y"))
    dots = met.groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    scored = dots.withColumn("similarity", tanimoto(F.col("dot"), F.col("nx"), F.col("ny"))).filter(F.col("similarity") >= least)
    return scored.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")


def neighbourhoods(edges: DataFrame, definition: int) -> DataFrame:
    """(via, node, w, leaf): inclusive neighbourhoods, and whether the node has one neighbour only."""
    degree = adjacency(edges).groupBy("node").agg((F.count("*") == 1).alias("leaf"))
    return adjacency(edges, definition).select(F.col("other").alias("via"), "node", "w").join(degree, "node")


def with_keystones(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(keystone, i, j, similarity): the pairs (i, j, similarity) at each node that has an edge to both."""
    near = adjacency(edges).select("node", F.col("other").alias("keystone"))
    at_i, at_j = near.withColumnRenamed("node", "i"), near.withColumnRenamed("node", "j")
    return pairs.join(at_i, "i").join(at_j, ["j", "keystone"]).select("keystone", "i", "j", "similarity")


def edge_similarity(edges: DataFrame, definition: int = 0, least: float = 0.0) -> DataFrame:
    """(keystone, i, j, similarity) of the edges (keystone, i) and (keystone, j): Tanimoto of the far ends, to 5 places.

    All pairs that reach `least`, and none below it are made where the norms alone rule them out.
    """
    return with_keystones(similar_nodes(neighbourhoods(edges, definition), least, True), edges)


def edge_links(edges: DataFrame, definition: int = 0, least: float = 0.1) -> DataFrame:
    """Pairs of edge_similarity() that connect, at `least` and any cut above it, all that the pairs of it connect.

    They are all but those of two leaves, nodes of one edge. Leaves share nothing but their hub, so their similarity depends on two
    weights alone: with definition 0 only on their ratio, and the chain of a hub's leaves in order of weight connects what any
    pairs would; with definition 1 and weights up to the root of 2 it grows with either weight, and pairs with the heaviest leaf do. A
    star of n edges so has n - 1 pairs. With heavier weights of definition 1 all pairs of leaves are made.
    """
    near = cut(neighbourhoods(edges, definition))
    heaviest = near.filter("leaf and via <> node").agg(F.max("w")).first()[0] if definition == 1 else None
    every = heaviest is not None and heaviest > math.sqrt(2)
    pairs = similar_nodes(near, least, every)
    if every:
        return with_keystones(pairs, edges)
    leaves = near.filter("leaf and via <> node").select(F.col("via").alias("hub"), "node", "w")
    own = F.col("w") * F.col("w") + (F.col("w") * F.col("w") if definition == 0 else F.lit(1.0))
    if definition == 0:
        line = in_order(leaves, ["hub", "w", "node"], "at")
        one, two = line.select("hub", "at", "node", "w", own.alias("n")), line.select("hub", (F.col("at") - 1).alias("at"), F.col("node").alias("node2"), F.col("w").alias("w2"), own.alias("n2"))
        beside = one.join(two, ["hub", "at"])
    else:
        top = leaves.groupBy("hub").agg(F.max(F.struct("w", "node")).alias("top"))
        beside = leaves.withColumn("n", own).join(top, "hub").filter("node <> top.node").select("hub", "node", "w", "n", F.col("top.node").alias("node2"), F.col("top.w").alias("w2"), (F.col("top.w") * F.col("top.w") + 1).alias("n2"))
    scored = beside.withColumn("similarity", tanimoto(F.col("w") * F.col("w2"), F.col("n"), F.col("n2"))).filter(F.col("similarity") >= least)
    return with_keystones(pairs, edges).unionByName(scored.select(F.col("hub").alias("keystone"), F.least("node", "node2").alias("i"), F.greatest("node", "node2").alias("j"), "similarity"))


def combine_parallel(edges: DataFrame, how: str = "sum") -> DataFrame:
    """(a, b, weight) with parallel edges summed or reduced to the heaviest; loops stay."""
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return edges.groupBy(*ends).agg((F.sum if how == "sum" else F.max)("weight").alias("weight"))


def heavier(edges: DataFrame, than: float = 10.0) -> DataFrame:
    """The subgraph of the edges that weigh more; nodes without such an edge are not in it."""
    return edges.filter(F.col("weight") > than)


def size_of(edges: DataFrame) -> DataFrame:
    """(vertices, edges), one row; an edge counts as often as it stands, a vertex once."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).agg(F.count_distinct("node").alias("vertices"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("edges")))
