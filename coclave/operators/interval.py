"""Closed integer intervals on contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stabbing(hits: DataFrame, position: int, max_p: float, contig: str | None = None) -> DataFrame:
    """Hits that hold the position."""
    found = hits.filter((F.col("start") <= position) & (F.col("stop") >= position) & (F.col("pvalue") <= max_p))
    return found if contig is None else found.filter(F.col("contig") == contig)


def contained(hits: DataFrame, start: int, stop: int, contig: str) -> DataFrame:
    """Hits that lie inside [start, stop]."""
    return hits.filter((F.col("start") >= start) & (F.col("stop") <= stop) & (F.col("contig") == contig))


def dyadic(start: Column, stop: Column) -> Column:
    """The closed interval [start, stop] as structs (level, node): node covers [node * 2^level, (node + 1) * 2^level).

    The least such cover: at most two nodes a level, so twice the logarithm of the length; none where start > stop.
    """
    s, e = start.cast("long"), stop.cast("long") + 1

    def at(k: Column) -> Column:
        first, end = F.negative(F.call_function("shiftright", F.negative(s), k)), F.call_function("shiftright", e, k)
        node = lambda use, n: F.when(use & (first < end), F.struct(k.alias("level"), n.alias("node")))
        return F.array(node(F.pmod(first, F.lit(2)) == 1, first), node(F.pmod(end, F.lit(2)) == 1, end - 1))

    levels = F.sequence(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(F.greatest(e - s, F.lit(1)).cast("double"))).cast("int") + 1))
    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def holding(points: DataFrame, at: str, intervals: DataFrame, start: str, stop: str, contig: str = "contig") -> DataFrame:
    """All pairs of a point and a closed interval [start, stop] of its contig that holds it, with the columns of both.

    Both tables have `contig`, and no other name in common. An interval goes to the nodes of its dyadic cover, a point to the node of
    each level in use that holds it; they meet at exactly one. So what is joined by is an equal key, and a long interval costs
    the logarithm of its length. Points and bounds that are null, and null contigs, meet nothing.
    """
    covers = intervals.withColumn("__node", F.explode(dyadic(F.col(start), F.col(stop)))).withColumn("__level", F.col("__node.level")).withColumn("__node", F.col("__node.node"))
    levels = sorted(r[0] for r in covers.select("__level").distinct().collect())  # 63 at most
    probes = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    probes = probes.withColumn("__node", F.call_function("shiftright", F.col(at).cast("long"), F.col("__level")))
    return probes.join(covers, [contig, "__level", "__node"]).drop("__level", "__node")


#: Positions that share a mask, a bit for each.
WORD = 64


def masks(features: DataFrame, contig: str, start: Column, end: Column) -> DataFrame:
    """(contig, word, mask): which positions of each stretch of WORD any feature [start, end] holds.

    A feature gives a row for each word that it touches, and these are united by partial aggregates, so neither many features at
    one place nor long ones meet in one task, and a position has one row to meet however many features hold it.
    """
    spread = features.select(F.col(contig).alias("contig"), start.cast("long").alias("s"), end.cast("long").alias("e")).filter("s <= e")
    spread = spread.withColumn("word", F.explode(F.sequence(F.floor(F.col("s") / WORD), F.floor(F.col("e") / WORD))))
    low, high = F.greatest(F.col("s") - F.col("word") * WORD, F.lit(0)), F.least(F.col("e") - F.col("word") * WORD, F.lit(WORD - 1))
    own = F.expr("shiftleft(-1L, cast(low as int)) & shiftrightunsigned(-1L, cast(63 - high as int))")
    return spread.withColumn("low", low).withColumn("high", high).groupBy("contig", "word").agg(F.bit_or(own).alias("mask"))


def flag_points(points: DataFrame, at: list[str], features: DataFrame, contig: str = "contig", out: str = "in_coding_rgn") -> DataFrame:
    """Adds whether any of the positions `at` lies in a feature [start_pos, end_pos] of its contig.

    Each position meets the one mask of its word; a position or contig that is null lies in none.
    """
    held, done = masks(features, "contig", F.col("start_pos"), F.col("end_pos")), points
    for k, position in enumerate(at):
        own = held.select(F.col("contig").alias(contig), F.col("word").alias("__word"), F.col("mask").alias(f"__mask{k}"))
        done = done.withColumn("__word", F.floor(F.col(position) / WORD)).join(own, [contig, "__word"], "left").drop("__word")
    bit = lambda k, position: F.expr(f"shiftrightunsigned(__mask{k}, cast(pmod({position}, {WORD}) as int)) & 1L") == 1
    inside = [F.coalesce(bit(k, position), F.lit(False)) for k, position in enumerate(at)]
    any_of = inside[0]
    for one in inside[1:]:
        any_of |= one
    return done.withColumn(out, any_of).select(*points.columns, out)


def covered(features: DataFrame, contig: str = "contig") -> DataFrame:
    """(contig, covered): positions in the union of the half-open features [start_pos, end_pos)."""
    held = masks(features, contig, F.col("start_pos"), F.col("end_pos") - 1)
    return held.groupBy(F.col("contig").alias(contig)).agg(F.sum(F.bit_count("mask")).cast("long").alias("covered"))


def depth(hits: DataFrame, by: list[str], stretch: int = 1 << 16) -> DataFrame:
    """(by, position, depth): how many hits hold each position, for positions that any holds.

    From the ends of the hits, not from their positions: +1 at a start, -1 behind a stop, summed along the axis; only stretches of
    constant depth are spread out. The axis is cut into ranges of `stretch`; what runs into a range is summed over the ranges before
    it, so a task has one range of one contig.
    """
    ends = hits.select(*by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("__range", F.floor(F.col("at") / stretch))
    axis = Window.partitionBy(*by).orderBy("__range")
    ranges = steps.groupBy(*by, "__range").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    ranges = ranges.select(*by, "__range", F.coalesce(F.sum("d").over(axis.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lead("first").over(axis).alias("__next"))
    line = Window.partitionBy(*by, "__range").orderBy("at")
    own = steps.join(ranges, [*by, "__range"])
    depths = own.withColumn("depth", F.col("__before") + F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.coalesce(F.lead("at").over(line), F.col("__next")) - 1)
    return depths.filter("depth > 0").select(*by, F.explode(F.sequence("at", "until")).alias("position"), "depth")


def gre_hits(hits: DataFrame, motifs: DataFrame, by_motif: bool = False) -> DataFrame:
    """Hits with the gre_id of the motifs of their cluster: one row for each such motif, or of their own motif with by_motif."""
    named = motifs.filter("gre_id is not null")
    return hits.join(named.select("cluster_id", "motif_num", "gre_id"), ["cluster_id", "motif_num"]) if by_motif else hits.join(named.select("cluster_id", *(["motif_num"] if "motif_num" not in hits.columns else []), "gre_id"), "cluster_id")


def gre_positions(motifs: DataFrame, hits: DataFrame, gre_ids: list[int], max_evalue: float = 10.0, max_p: float = 10.0) -> DataFrame:
    """Hits of the motifs of these, both below their bounds."""
    own = motifs.filter(F.col("gre_id").isin(gre_ids) & (F.col("evalue") < max_evalue)).select("cluster_id", "motif_num", "gre_id")
    return own.join(hits.filter(F.col("pvalue") < max_p), ["cluster_id", "motif_num"]).select("gre_id", "cluster_id", "motif_num", "contig", "start", "stop", "pvalue")


def coding_fraction(flagged: DataFrame, by: list[str], flag: str = "in_coding_rgn") -> DataFrame:
    return flagged.groupBy(*by).agg(F.round(F.avg(F.col(flag).cast("double")), 4).alias("coding_frac"))
