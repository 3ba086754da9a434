"""Where on a chromosome the motifs of regulatory elements are found: one entry from a locus to hits, depths or a browser track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.operators import interval
from coclave.sources import sinks

FORMS = ("hits", "series", "track")


def chromosome(genome: DataFrame, locus: str | int) -> tuple[str, str, int]:
    """(scaffold, refseq, length) of the row of (scaffold, refseq, length) that has the locus as either name."""
    named = genome.select(*(F.col(c).cast("string").alias(c) for c in ("scaffold", "refseq")), F.col("length").cast("long"))
    found = named.filter((F.col("scaffold") == str(locus)) | (F.col("refseq") == str(locus))).orderBy("scaffold", "refseq").limit(1).collect()
    if not found:
        some = [f"{r['scaffold']} ({r['refseq']})" for r in named.orderBy("scaffold", "refseq").limit(20).collect()]
        raise ValueError(f"no chromosome {locus}; there are {', '.join(some) or 'none'}")
    return tuple(found[0])


def find_scans(genome: DataFrame, hits: DataFrame, motifs: DataFrame, locus: str | int, start: int | None = None, stop: int | None = None, gre_ids: list[int] | None = None, max_p: float | None = None, form: str = "track", path: str | None = None) -> DataFrame:
    """Hits that lie in [start, stop] of a chromosome, of the clusters of these GREs or of any, in one of FORMS.

    Without start it is 0, without stop the chromosome's length. `hits` gives (gre_id, cluster_id, motif_num, start, stop, pvalue), one row
    for each motif of the hit's cluster that has a GRE; `series` (gre_id, position, depth), how many of these hold a position; `track`
    the same as start, end, strand, chr, value, id, chr being the RefSeq name. With a path the track is written there too, a
    folder for each GRE. Motifs without a GRE and hits on other chromosomes are in none of them.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}")
    scaffold, refseq, length = chromosome(genome, locus)
    inside = interval.contained(hits, 0 if start is None else start, length if stop is None else stop, scaffold)
    inside = inside if max_p is None else inside.filter(F.col("pvalue") <= max_p)
    wanted = motifs if gre_ids is None else motifs.filter(F.col("gre_id").isin(sorted(set(gre_ids))))
    named = interval.gre_hits(inside.drop("motif_num"), wanted)
    if form == "hits":
        return named.select("gre_id", "cluster_id", "motif_num", "start", "stop", "pvalue")
    depth = interval.depth(named, ["gre_id"]).select("gre_id", "position", "depth")
    if path is not None:
        sinks.browser_track(depth, refseq, path)
    if form == "series":
        return depth
    return depth.select(F.col("position").alias("start"), F.col("position").alias("end"), F.lit("+").alias("strand"), F.lit(refseq).alias("chr"), F.col("depth").alias("value"), F.concat(F.lit("GRE_"), F.col("gre_id").cast("string")).alias("id"))
