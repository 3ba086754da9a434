"""Which things go with a selection of groups more often than chance has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.functions.stats import adjusted, adjusted_within, hypergeom_sf


def counts(bridge: DataFrame, member: str, selected: DataFrame | None = None, group: str = "cluster_id") -> DataFrame:
    """(key, counts) of a member's groups, over all groups or the selected ones."""
    inside = bridge if selected is None else bridge.join(selected.select(group), group, "left_semi")
    return inside.groupBy(F.col(member).alias("key")).agg(F.count("*").alias("counts"))


def enrichment(bridge: DataFrame, member: str, selected: DataFrame, population: DataFrame, known: DataFrame | None = None, drawn_rows: bool = False, least: int = 0, cutoff: float | None = 0.05, group: str = "cluster_id", inclusive: bool = False) -> DataFrame:
    """(key, counts, all_counts, pval, qval_bh, qval_bonferroni) of the members of the selected groups.

    counts are in the selection, all_counts everywhere; keys below `least` in all_counts are not tested. The population is the
    number of groups, the draw the number of selected groups, or of their bridge rows with drawn_rows. Tests are corrected
    over all keys of the selection, then cut at `cutoff`. Both sizes are one-row aggregates joined to the keys.
    """
    inside = bridge.join(selected.select(group), group, "left_semi")
    own = inside.groupBy(F.col(member).alias("key")).agg(F.count("*").alias("counts"))
    everywhere = bridge.groupBy(F.col(member).alias("key")).agg(F.count("*").alias("all_counts"))
    # One row each.
    sizes = population.agg(F.count("*").alias("population")).crossJoin((inside if drawn_rows else selected).agg(F.count("*").alias("drawn")))
    both = own.join(everywhere, "key").filter(F.col("all_counts") >= least)
    if known is not None:
        both = both.join(known.select(F.col(known.columns[0]).alias("key")), "key", "left_semi")
    tested = both.crossJoin(F.broadcast(sizes)).withColumn("pval", _sf("counts", "population", "all_counts", "drawn", inclusive)).drop("population", "drawn")
    done = adjusted(tested)
    return done if cutoff is None else done.filter(F.col("pval") <= cutoff)


def enrichment_of_sets(sets: DataFrame, bridge: DataFrame, wanted: str, member: str, population: DataFrame, cutoff: float | None = 0.05, group: str = "cluster_id", inclusive: bool = False, target: DataFrame | None = None) -> DataFrame:
    """enrichment() of many selections at once: (set_id, key, counts, all_counts, pval, qval_bh, qval_bonferroni).

    `sets` is (set_id, `wanted`); a set selects the groups of `bridge` that hold any of its members, and the keys are the `member`s of
    `target`, bridge if not given, in these groups. Corrections are within a set. All sets go through the same joins and sums; what
    one of them has is a group of its keys, never a plan of its own.
    """
    target = bridge if target is None else target
    chosen = sets.select("set_id", wanted).distinct().join(bridge.select(wanted, group), wanted).select("set_id", group).distinct()
    drawn = chosen.groupBy("set_id").agg(F.count("*").alias("drawn"))
    own = chosen.join(target.select(group, F.col(member).alias("key")), group).groupBy("set_id", "key").agg(F.count("*").alias("counts"))
    everywhere = target.groupBy(F.col(member).alias("key")).agg(F.count("*").alias("all_counts"))
    size = population.agg(F.count("*").alias("population"))  # one row
    both = own.join(everywhere, "key").join(drawn, "set_id").crossJoin(F.broadcast(size))
    done = adjusted_within(both.withColumn("pval", _sf("counts", "population", "all_counts", "drawn", inclusive)).drop("population", "drawn"), ["set_id"])
    return (done if cutoff is None else done.filter(F.col("pval") <= cutoff)).select("set_id", "key", "counts", "all_counts", "pval", "qval_bh", "qval_bonferroni")


def _sf(k: str, m: str, n: str, d: str, inclusive: bool) -> Column:
    return hypergeom_sf(F.col(k), F.col(m), F.col(n), F.col(d), inclusive)
