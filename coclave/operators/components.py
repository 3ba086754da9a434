"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.runtime import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node under the least of them.

    The minimum is a partial aggregate and the second side an ordinary equi join, so AQE can split a hub's rows.
    """
    if small:
        pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    else:
        pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
            edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
        )
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select(F.col("u").alias("src"), F.col("m").alias("dst"))
        )
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return moved.filter("src <> dst").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that each endpoint reaches.

    Loops and edges with a null end add nothing but, for loops, their node. Order, direction and repeats of edges do not
    matter. Nodes without an edge are not in the result. Each round is cut with checkpoint().
    """
    named = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    start = cut(named.distinct())
    loops = start.filter("src = dst").select(F.col("src").alias("node"))
    now = start.filter("src <> dst")
    before = None
    while True:
        now = cut(_stars(_stars(now, small=False), small=True))
        state = _state(now)
        if state == before:
            break
        before = state
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    alone = loops.join(found.select("node").unionByName(roots.select("node")).distinct(), "node", "left_anti")
    return found.unionByName(roots.distinct()).unionByName(alone.distinct().select("node", F.col("node").alias("component")))
