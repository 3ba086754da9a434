"""Motif matrices, motif-pair graphs, and Markov clustering of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.operators.components import components
from coclave.operators.number import in_order
from coclave.runtime import cut, small

#: Entries of one row of a matrix that meet in one task; rows with more are dealt out.
HUB = 1 << 16


def motif_id(run: Column, cluster: Column, motif: Column) -> Column:
    """run_ccc_mm."""
    return F.format_string("%s_%03d_%02d", run.cast("string"), cluster.cast("int"), motif.cast("int"))


def parse_motif_id(name: Column) -> Column:
    """struct(run, cluster, motif_num); the run may itself hold underscores."""
    parts = F.split(name, "_")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, 1, n - 2), "_").alias("run"), F.get(parts, n - 2).cast("int").alias("cluster"), F.get(parts, n - 1).cast("int").alias("motif_num")
    )


def matrices(pwm: DataFrame, by: list[str], letters: str = "acgt") -> DataFrame:
    """(by, matrix): the rows of each motif in order as an array of structs with the letters in the order asked for."""
    row = F.struct("row", F.struct(*letters).alias("p"))
    return pwm.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["p"]).alias("matrix"))


#: Fixed values of the MEME format, version 3.0.
MEME_HEAD = "MEME version 3.0\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies (from dataset with add-one prior applied):\n"


def meme_header(a: float = 0.284, c: float = 0.216, g: float = 0.216, t: float = 0.284) -> str:
    return f"{MEME_HEAD}A {a:.3f} C {c:.3f} G {g:.3f} T {t:.3f}\n"


def meme_blocks(pwm: DataFrame, by: list[str], exported: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """(by, block): the matrix of each motif as text, letters to 3 places.

    With exported (by, num_sites, evalue) only motifs that it has, with these; with a name its lines come first.
    """
    line = F.concat_ws(" ", *(F.format_string("%5.3f", c) for c in "acgt"))
    rows = pwm.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("rows"))
    sites, evalue = F.lit("0"), F.lit("")
    if exported is not None:
        rows = rows.join(exported.select(*by, "num_sites", "evalue"), by)
        sites, evalue = F.col("num_sites").cast("string"), F.format_string(" E= %.3e", F.col("evalue").cast("double"))
    head = F.concat(F.lit("letter-probability matrix: alength= 4 w= "), F.size("rows").cast("string"), F.lit(" nsites= "), sites, evalue)
    if name is not None:
        head = F.concat(F.lit("\nMOTIF "), name, F.lit("\nBL   MOTIF "), name, F.lit(" width=0 seqs=0\n"), head)
    return rows.select(*by, F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("block"))


def exportable(motifs: DataFrame, sites: DataFrame, clusters: DataFrame, max_residual: float | None = None, max_evalue: float | None = None, bridge: DataFrame | None = None, row_id: object = None) -> DataFrame:
    """(cluster_id, motif_num, evalue, residual, num_sites) of the motifs that have a site.

    num_sites counts sites with a p-value. Either limit may be left out; with a bridge only clusters that hold the row count. Sites
    are counted before anything is joined.
    """
    key = ["cluster_id", "motif_num"]
    counted = sites.groupBy(*key).agg(F.count("pvalue").alias("num_sites"))
    own = motifs if max_evalue is None else motifs.filter(F.col("evalue") <= max_evalue)
    kept = clusters if max_residual is None else clusters.filter(F.col("residual") <= max_residual)
    if bridge is not None:
        kept = kept.join(bridge.filter(F.col("row_id") == row_id).select("cluster_id"), "cluster_id", "left_semi")
    return own.select(*key, "evalue").join(kept.select("cluster_id", "residual"), "cluster_id").join(counted, key).select(*key, "evalue", "residual", "num_sites")


def load_motifs(motifs: DataFrame, children: dict[str, DataFrame], first: int = 1) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Motifs with a number motif_info_id in order of (cluster_id, motif_num), and every child table by that number in place of these."""
    key = ["cluster_id", "motif_num"]
    named = in_order(motifs, key, "motif_info_id", first)
    ids = named.select("motif_info_id", *key)
    return named, {name: child.join(ids, key).drop(*key) for name, child in children.items()}


def best_sites(sites: DataFrame, sizes: DataFrame, large: int = 100) -> DataFrame:
    """(cluster, name, pvalue, start, n): the site of lowest p-value of each name in a cluster, and how many sites the name has there.

    sites: (cluster, name, pvalue, start); sizes: (cluster, motifs). In a cluster of more than `large` motifs only names with more
    than a twentieth as many sites stay; in others, and where this leaves two names or fewer, only those with more than 2.
    """
    first = F.min_by(F.struct("pvalue", "start"), F.struct("pvalue", "start"))
    each = sites.groupBy("cluster", "name").agg(first.alias("best"), F.count("*").alias("n")).join(sizes, "cluster")
    big, often = F.col("motifs") > large, F.col("n") > F.col("motifs") / 20
    left = F.sum((big & often).cast("int")).over(Window.partitionBy("cluster"))
    kept = each.withColumn("__left", left).filter((~big | often) & ((big & (F.col("__left") > 2)) | (F.col("n") > 2)))
    return kept.select("cluster", "name", "best.pvalue", "best.start", "n")


def gene_counts(motifs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(gre_id, row_id, counts): how often each row is in the clusters of a motif cluster, most often first within each."""
    held = motifs.select("cluster_id", "gre_id").join(bridge, "cluster_id").groupBy("gre_id", "row_id").agg(F.count("*").alias("counts"))
    return held.orderBy("gre_id", F.col("counts").desc(), "row_id")


def renormalised(evalue: Column) -> Column:
    """An e-value in text with its first part below 10: 10.0e+003 as 1.0e+004; others, and what is no number, as they are."""
    text = F.format_string("%.1e", F.expr("1D") * evalue.try_cast("double"))
    exponent = F.substring_index(text, "e", -1).try_cast("int")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    new = F.concat(F.substring_index(text, "e", 1), F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 3, "0"))
    return F.when(F.abs(F.substring_index(F.lower(evalue), "e", 1).try_cast("double")) >= 10, F.coalesce(new, evalue)).otherwise(evalue)


def pair_filter(pairs: DataFrame, fractions: DataFrame | None = None, max_p: float = 0.01, least_overlap: int = 6, coding: float | None = None) -> DataFrame:
    """Pairs of different motifs, significant and long enough; with fractions (motif, coding_frac), one end must be below `coding`."""
    kept = pairs.filter((F.col("pvalue") <= max_p) & (F.col("query") != F.col("target")) & (F.col("overlap") >= least_overlap))
    if fractions is None or coding is None:
        return kept
    x, y = (fractions.select(F.col("motif").alias(end), F.col("coding_frac").alias(f"frac_{end}")) for end in ("query", "target"))
    both = kept.join(x, "query", "left").join(y, "target", "left")
    return both.filter((F.col("frac_query") < coding) | (F.col("frac_target") < coding))


def best_of_repeats(pairs: DataFrame) -> DataFrame:
    """Each (query, target) once, with its lowest p-value."""
    line = Window.partitionBy("query", "target").orderBy("pvalue", "overlap")
    return pairs.withColumn("__rank", F.row_number().over(line)).filter("__rank = 1").drop("__rank")


def pair_weights(pairs: DataFrame) -> DataFrame:
    """(a, b, weight) with weight -log10(p + 1e-99), to 4 places."""
    return pairs.select(F.col("query").alias("a"), F.col("target").alias("b"), F.round(-F.log10(F.col("pvalue") + 1e-99), 4).alias("weight"))


def cluster_stats(sizes: DataFrame, least: int = 10) -> DataFrame:
    """From (cluster, n): clusters, motifs, clusters of `least` and more, and their share of the motifs."""
    big = F.col("n") >= least
    return sizes.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("motifs"), F.sum(big.cast("int")).alias("big"),
        F.round(F.try_divide(F.sum(F.when(big, F.col("n")).otherwise(0)), F.sum("n")), 4).alias("share"),
    )


def within_clusters(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs of which both motifs are in one cluster of (cluster, motif)."""
    x, y = clusters.select("cluster", F.col("motif").alias("query")), clusters.select("cluster", F.col("motif").alias("target"))
    return pairs.join(x, "query").join(y, ["target", "cluster"])


def numbered_clusters(lines: DataFrame, least: int = 4) -> DataFrame:
    """(gre_id, motif) from lines (pos, line) of tab-separated motifs; only lines of `least` motifs and more get a number."""
    kept = lines.withColumn("motifs", F.split("line", "\t")).filter(F.size("motifs") >= least)
    return in_order(kept, ["pos"], "gre_id", 1).select(F.col("gre_id").cast("int").alias("gre_id"), F.explode("motifs").alias("motif"))


def set_gre_ids(motifs: DataFrame, found: DataFrame) -> DataFrame:
    """motifs with gre_id taken from found (cluster_id, motif_num, gre_id) where it has one."""
    named = found.select("cluster_id", "motif_num", F.col("gre_id").alias("__gre"))
    return motifs.join(named, ["cluster_id", "motif_num"], "left").withColumn("gre_id", F.coalesce("__gre", "gre_id")).drop("__gre")


def _stochastic(m: DataFrame) -> DataFrame:
    return m.join(m.groupBy("col").agg(F.sum("p").alias("__sum")), "col").select("row", "col", (F.col("p") / F.col("__sum")).alias("p"))


def markov_start(edges: DataFrame) -> DataFrame:
    """(row, col, p): the column-stochastic matrix of (a, b, weight), both ways, each node with a loop of its heaviest edge."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    loops = both.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")
    return _stochastic(both.filter("a <> b").unionByName(loops).groupBy(F.col("a").alias("row"), F.col("b").alias("col")).agg(F.max("weight").alias("p")))


def _squared(now: DataFrame) -> DataFrame:
    """The square of (row, col, p). The columns that hold a hub are dealt out over several tasks, each with the hub's own column."""
    n = F.ceil(F.count("*") / F.lit(HUB)).cast("int")
    hubs = small(now.groupBy(F.col("row").alias("via")).agg(n.alias("parts")).filter("parts > 1"), "hubs")
    parts = F.coalesce("parts", F.lit(1))
    left = now.select("row", F.col("col").alias("via"), F.col("p").alias("x")).join(hubs, "via", "left")
    right = now.select(F.col("row").alias("via"), "col", F.col("p").alias("y")).join(hubs, "via", "left")
    left = left.select("row", "via", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = right.select("via", "col", "y", F.pmod(F.xxhash64("col"), parts).cast("int").alias("part"))
    return left.join(right, ["via", "part"]).groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("p"))


def strongest(entries: DataFrame, least: float, most: int, recover: int = 0, share: float = 0.9) -> DataFrame:
    """Of each column of (row, col, p) the entries of `least` and more, but only the `most` largest of them; where these are fewer
    than `recover` and have less than `share` of the column's sum, its `recover` largest.

    Entries are ranked by p to 9 places, then by row; those that round to 0 go. Columns are tallied by 16 steps to each doubling of p:
    whole steps stay or go, and only the step in which the number is reached is ranked, so a long column is sorted whole only
    where its entries are nearly all alike.
    """
    sized = cut(entries.select("row", "col", "p", F.round("p", 9).alias("size")).filter("size > 0").withColumn("step", F.floor(F.log2("size") * 16)))
    column, fits = Window.partitionBy("col"), F.col("p") >= least
    tally = sized.groupBy("col", "step").agg(
        F.count("*").alias("n"), F.sum(fits.cast("long")).alias("fit"), F.sum(F.when(fits, F.col("p")).otherwise(0.0)).alias("mass"), F.sum("p").alias("whole")
    )
    fit = F.sum("fit").over(column)
    few = (fit < recover) & (F.sum("mass").over(column) < F.lit(share) * F.sum("whole").over(column))
    before = F.coalesce(F.sum("n").over(column.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = tally.select("col", "step", "n", (F.when(few, F.lit(recover)).otherwise(F.least(fit, F.lit(most))) - before).alias("room")).filter("room > 0")
    placed = sized.join(room, ["col", "step"])
    rank = F.row_number().over(Window.partitionBy("col", "step").orderBy(F.col("size").desc(), "row"))
    ranked = placed.filter("room < n").withColumn("rank", rank).filter("rank <= room")
    return placed.filter("room >= n").select("row", "col", "p").unionByName(ranked.select("row", "col", "p"))


def markov_round(now: DataFrame, inflation: float = 2.4, least: float = 1e-4, most: int | None = None, recover: int = 0, share: float = 0.9) -> DataFrame:
    """One expansion, inflation and pruning of (row, col, p): by `least` alone, or with `most` as in strongest()."""
    inflated = _stochastic(_squared(now).withColumn("p", F.pow("p", F.lit(inflation))))
    return _stochastic(inflated.filter(F.col("p") >= least) if most is None else cut(strongest(inflated, least, most, recover, share)))


def markov_clusters(
    edges: DataFrame, inflation: float = 2.4, least: float = 1e-4, rounds: int = 30, most: int | None = None, recover: int = 0, share: float = 0.9
) -> DataFrame:
    """(node, cluster): expansion and inflation of the column-stochastic matrix of (a, b, weight) until nothing changes.

    Both steps are joins and sums on sparse (row, col, p) entries; entries below `least` go, and with `most` a column has that many
    at most, as strongest() says. Nodes of one cluster share an attractor; the cluster is the least node that they reach. No edges
    give no rows.
    """
    now = cut(markov_start(edges))
    for _ in range(rounds):
        after = cut(markov_round(now, inflation, least, most, recover, share))
        change = after.join(now.withColumnRenamed("p", "before"), ["row", "col"], "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
        now = after
        if change is None or change < 1e-3:
            break
    return components(now.filter("p > 0.01").select("row", "col"), "row", "col").withColumnRenamed("component", "cluster")
