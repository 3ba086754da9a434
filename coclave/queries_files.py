"""Readers and sinks as queries: tables are written as the files that ensembles come in, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.operators import blocks, communities, graph, interval, resample
from coclave.operators.expression import zscore
from coclave.queries import GRAPH_SQL, LINKED_SQL, THRESHOLDS, edges_of, query
from coclave.runtime import cut, fresh_path
from coclave.sources import files, sinks
from coclave.sources.star import Star


def one_file(df: DataFrame, path: str, **options: str) -> None:
    """The rows of a small frame as one text file of this very name: as CSV with options, else its only column as lines."""
    spark = df.sparkSession
    whole = df.coalesce(1).write
    whole.options(**options).csv(f"{path}.parts") if options else whole.text(f"{path}.parts")
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in system.listStatus(at(f"{path}.parts")) if f.getPath().getName().startswith("part-"))
    system.mkdirs(at(path).getParent())
    system.rename(part, at(path))
    system.delete(at(f"{path}.parts"), True)


TABS = {"sep": "\t", "header": "true"}


@query("source_ratios", """w AS (SELECT 'P' || p_partkey AS row, p_size::DOUBLE AS c1, p_retailprice AS c2, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2.0 END AS c3 FROM part),
l AS (SELECT row, 'c1' AS col, c1 AS raw FROM w UNION ALL SELECT row, 'c2', c2 FROM w UNION ALL SELECT row, 'c3', c3 FROM w)
SELECT row, col, round(raw, 6) AS raw, round((raw - avg(raw) OVER (PARTITION BY row)) / nullif(stddev_samp(raw) OVER (PARTITION BY row), 0), 6) + 0.0 AS std FROM l""")
def _(m: Star) -> DataFrame:
    wide = m.raw("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_size").cast("double").alias("c1"), F.col("p_retailprice").alias("c2"),
        F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") * 2.0).cast("string")).otherwise("NA").alias("c3"),
    )
    path = fresh_path(m.spark, "ratios")
    wide.write.options(**TABS).csv(path)
    return files.ratios(m.spark, path).select("row", "col", F.round("raw", 6).alias("raw"), (F.round("std", 6) + 0.0).alias("std"))


@query("source_fasta", "SELECT n_name AS refseq, 'seq ' || n_name || ' of ' || n_regionkey AS header, upper(translate(md5(n_name), '0123456789abcdef', 'acgtacgtacgtacgt')) AS sequence FROM nation")
def _(m: Star) -> DataFrame:
    letters = F.translate(F.md5("n_name"), "0123456789abcdef", "acgtacgtacgtacgt")
    text = F.concat(F.lit(">seq "), "n_name", F.lit(" of "), F.col("n_regionkey").cast("string"), F.lit("\n"), F.substring(letters, 1, 20), F.lit("\n"), F.substring(letters, 21, 12))
    path = fresh_path(m.spark, "fasta")
    m.raw("nation").select(text.alias("value")).write.text(path)
    return files.fasta(m.spark, path)


@query("source_annotations", "w AS (SELECT 'P' || p_partkey AS name, p_brand, CASE WHEN p_size > 20 THEN p_size::VARCHAR END AS size FROM part WHERE p_partkey % 3 = 0) SELECT name, 'brand' AS annotation, p_brand AS value FROM w UNION ALL SELECT name, 'size', size FROM w WHERE size IS NOT NULL")
def _(m: Star) -> DataFrame:
    part = m.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sysName"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 20, F.col("p_size").cast("string")).otherwise(" ").alias("size"), "p_partkey")
    path = fresh_path(m.spark, "annotations")
    part.drop("p_partkey").write.options(**TABS).csv(path)
    return files.annotations(m.spark, path, part.filter("p_partkey % 3 = 0").select("sysName"))


RUNS = (0, 1, 2)


def scans_of(m: Star, folder: str) -> dict[str, str]:
    """A file of scans for each of three clusters in each of RUNS."""
    table = m.raw("events").select(
        (F.col("event_id") % 3 + 1).alias("#pattern name"), F.concat(F.lit("chr.x_"), "event_type", F.lit("_1.fa")).alias("sequence name"), F.col("event_id").alias("start"), (F.col("event_id") + 9).alias("stop"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("value").alias("score"), ((F.col("event_id") % 100) / 1e6).alias("p-value"), (F.col("user_id") % 9).alias("group"),
    )
    for k in RUNS:
        for c in range(3):
            one_file(table.filter(F.col("group") == 3 * k + c).drop("group"), f"{folder}/run{k}/fimo-out-{c}", **TABS)
    return {f"run{k}": f"{folder}/run{k}/fimo-out-*" for k in RUNS}


@query("source_scans", "SELECT 'run' || (user_id % 9) // 3 AS run_id, ((user_id % 9) % 3)::INT AS cluster, (event_id % 3 + 1)::INT AS motif_num, event_type || '_1' AS contig, event_id::INT AS start, (event_id + 9)::INT AS stop, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, round(value, 6) AS score FROM events WHERE event_id % 100 <= 10")
def _(m: Star) -> DataFrame:
    folder = fresh_path(m.spark, "scans")
    saved = fresh_path(m.spark, "scans-by-run")
    sinks.save(files.scan_table(m.spark, scans_of(m, folder)), saved, ["run_id"])
    return m.spark.read.parquet(saved).select("run_id", "cluster", "motif_num", "contig", "start", "stop", "strand", F.round("score", 6).alias("score"))


@query("source_motif_pairs", "SELECT s_name AS query, n_name AS target, round(s_suppkey / 1e4, 6) AS pvalue, (s_suppkey % 12)::INT AS overlap, upper(n_name) AS query_consensus, NULL::VARCHAR AS target_consensus FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(m: Star) -> DataFrame:
    both = m.raw("supplier").join(m.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    table = both.select(F.col("s_name").alias("#Query ID"), F.col("n_name").alias("Target ID"), (F.col("s_suppkey") / 1e4).alias("p-value"), (F.col("s_suppkey") % 12).alias("Overlap"), F.upper("n_name").alias("Query consensus"))
    path = fresh_path(m.spark, "pairs")
    table.write.options(**TABS).csv(path)
    return files.motif_pairs(m.spark, path).withColumn("pvalue", F.round("pvalue", 6))


@query("source_features", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'CDS' ELSE 'tRNA' END AS type, 'c' || s_nationkey AS contig, (s_suppkey * 10)::INT AS start_pos, (s_suppkey * 10 + 5)::INT AS end_pos FROM supplier")
def _(m: Star) -> DataFrame:
    tab = "\t"
    at = F.col("s_suppkey")
    rows = m.raw("supplier").select(
        (at + 3).alias("pos"),
        F.concat_ws(tab, F.concat(F.lit("f"), at.cast("string")), F.when(at % 2 == 0, "CDS").otherwise("tRNA"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), F.concat(F.lit("<"), (at * 10).cast("string")), F.concat(F.lit(">"), (at * 10 + 5).cast("string"))).alias("line"),
    )
    head = m.spark.createDataFrame([(0, "-- some text"), (1, "-- header"), (2, tab.join(["-- id", "type", "contig", "start_pos", "end_pos"])), (1 << 40, tab.join(["x", "SEQ_END", "c0", "1", "2"]))], "pos long, line string")
    path = fresh_path(m.spark, "features")
    one_file(head.unionByName(rows).orderBy("pos").select("line"), f"{path}/features.tab")
    return files.features(m.spark, f"{path}/features.tab")


@query("source_blocks", "SELECT sample, block FROM blocks")
def _(m: Star) -> DataFrame:
    path = fresh_path(m.spark, "blocks")
    m.blocks.select(F.concat(F.lit(" "), "sample").alias("sample "), F.concat("block", F.lit("  ")).alias("block")).write.csv(path, header=True)
    return files.blocks(m.spark, path).select("sample", "block")


@query("source_runs", "SELECT 'run' || cluster_id % 4 AS run_id, (cluster_id // 4 % 3)::INT AS iteration, cluster_id FROM biclusters b WHERE cluster_id % 4 <> 3 AND cluster_id // 4 % 3 = (SELECT max(cluster_id // 4 % 3) FROM biclusters x WHERE x.cluster_id % 4 = b.cluster_id % 4)")
def _(m: Star) -> DataFrame:
    """Four runs of which the last has not finished; the last iteration of each of the others."""
    folder = fresh_path(m.spark, "runs")
    for k in range(4):
        own = m.biclusters.filter(F.col("cluster_id") % 4 == k).select("cluster_id", F.expr("cast(cluster_id div 4 % 3 as int)").alias("iteration"))
        sinks.save(own, f"{folder}/{k}/biclusters")
        sinks.save(m.spark.range(1).select(F.lit("511145").alias("ncbi_code"), F.when(F.lit(k < 3), F.current_timestamp()).alias("finish_time")), f"{folder}/{k}/run_infos")
    whole = files.run_table(m.spark, {f"run{k}": f"{folder}/{k}" for k in range(4)}, "biclusters")
    return files.last_iteration(whole, ["run_id"]).select("run_id", "iteration", "cluster_id")


@query("sink_numbered_names", "SELECT row_number() OVER (ORDER BY name) AS row_id, name FROM (SELECT DISTINCT p_name AS name FROM part)")
def _(m: Star) -> DataFrame:
    return sinks.numbered(m.raw("part").select(F.col("p_name").alias("name")), "row_id")


@query("sink_expression_table", """r AS (SELECT row_number() OVER (ORDER BY name) AS row_id, name FROM (SELECT DISTINCT sys_name AS name FROM row_info)), c AS (SELECT row_number() OVER (ORDER BY name) AS col_id, name FROM (SELECT DISTINCT name FROM col_info))
SELECT r.row_id, c.col_id, round((raw - avg(raw) OVER w) / nullif(stddev_samp(raw) OVER w, 0), 6) + 0.0 AS std FROM expr JOIN row_info i ON i.row_id = expr.row_id JOIN col_info j ON j.col_id = expr.col_id JOIN r ON r.name = i.sys_name JOIN c ON c.name = j.name WINDOW w AS (PARTITION BY expr.row_id)""")
def _(m: Star) -> DataFrame:
    named = m.expr.join(m.row_info.select("row_id", F.col("sys_name").alias("row")), "row_id").join(m.col_info.select("col_id", F.col("name").alias("col")), "col_id").select("row", "col", "raw")
    rows = sinks.numbered(m.row_info.select(F.col("sys_name").alias("name")), "row_id")
    cols = sinks.numbered(m.col_info.select("name"), "col_id")
    done = sinks.expression_table(zscore(named, "row", "raw", "std"), rows, cols)
    return done.select("row_id", "col_id", (F.round("std", 6) + 0.0).alias("std"))


GRE_DEPTH = "d AS (SELECT gre_id, position, count(*) AS value FROM (SELECT gre_id, unnest(range(start, stop + 1)) AS position FROM hits JOIN motifs USING (cluster_id, motif_num) WHERE gre_id IN (11, 12)) GROUP BY ALL)"


@query("sink_browser_track", f"{GRE_DEPTH} SELECT 'GRE_' || gre_id AS id, position::INT AS start, position::INT AS end, '+' AS strand, 'chr' AS chr, value::INT AS value FROM d")
def _(m: Star) -> DataFrame:
    named = interval.gre_hits(m.hits, m.motifs.filter("gre_id in (11, 12)"), by_motif=True)
    path = fresh_path(m.spark, "track")
    sinks.browser_track(interval.depth(named, ["gre_id"]), "chr", path)
    return m.spark.read.schema("start int, end int, strand string, chr string, value int, id string").csv(path, sep="\t", header=True)


@query("sink_module_track", "SELECT 'P' || p_partkey AS gene, 'chr' AS chr, p_partkey::INT AS start, (p_partkey + p_size)::INT AS stop FROM part")
def _(m: Star) -> DataFrame:
    path = fresh_path(m.spark, "module")
    genes = m.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("stop"))
    sinks.module_track(genes, "chr", path)
    return m.spark.read.schema("gene string, chr string, start int, stop int").csv(path, sep="\t", header=True)


@query("sink_sub_matrix", "SELECT row_id::VARCHAR AS row, round(max(CASE WHEN col_id = 1 THEN raw END), 6) AS c1, round(max(CASE WHEN col_id = 2 THEN raw END), 6) AS c2 FROM expr WHERE col_id IN (1, 2) GROUP BY 1")
def _(m: Star) -> DataFrame:
    path = fresh_path(m.spark, "matrix")
    cells = m.expr.select(F.col("row_id").cast("string").alias("row"), F.concat(F.lit("c"), F.col("col_id").cast("string")).alias("col"), F.round("raw", 6).alias("raw"))
    sinks.sub_matrix(cells, ["c1", "c2"], path)
    return m.spark.read.schema("row string, c1 double, c2 double").csv(path, sep="\t", header=True)


@query("sink_sites_fasta", "SELECT 'S' || s_suppkey AS refseq, 'S' || s_suppkey AS header, repeat('N', 20) || upper(translate(md5(s_name), '0123456789abcdef', 'acgtacgtacgtacgt')) || repeat('N', 20) AS sequence FROM supplier")
def _(m: Star) -> DataFrame:
    path = fresh_path(m.spark, "sites")
    sites = m.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.translate(F.md5("s_name"), "0123456789abcdef", "acgtacgtacgtacgt").alias("site"))
    sinks.sites_fasta(sites, path)
    return files.fasta(m.spark, path)


@query("sink_run_tables", "SELECT run_id, cluster_id, residual FROM biclusters WHERE run_id < 4 AND run_id <> 2 UNION ALL SELECT 2, -1, 0.5::DOUBLE")
def _(m: Star) -> DataFrame:
    """Four runs in folders of their own, of which the third is then written anew."""
    path = fresh_path(m.spark, "runs")
    sinks.save(m.biclusters.filter("run_id < 4").select("run_id", "cluster_id", "residual"), path, ["run_id"], "overwrite")
    sinks.save(m.spark.sql("SELECT 2L AS run_id, -1L AS cluster_id, 0.5D AS residual"), path, ["run_id"], "overwrite")
    return m.spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "cluster_id", "residual")


@query("source_ensembles", "SELECT n_regionkey::VARCHAR AS organism, min(n_name) AS species FROM nation GROUP BY 1")
def _(m: Star) -> DataFrame:
    return files.ensembles(m.raw("nation").select(F.col("n_regionkey").cast("string").alias("organism"), F.col("n_name").alias("species")))


@query("missing_nulls", "SELECT col_id FROM col_info WHERE col_id % 3 <> 0 OR col_id % 2 <> 0")
def _(m: Star) -> DataFrame:
    """Columns without 1,000 draws of sets of 5: a third has a distribution, and half of these too few draws."""
    stored = m.col_info.filter("col_id % 3 = 0").select("col_id", F.lit(5).alias("nrows"), F.when(F.col("col_id") % 2 == 0, 1000).otherwise(10).alias("resamples"))
    return resample.missing_nulls(m.col_info.select("col_id"), stored, 5, 1000)


@query("set_combinations", "SELECT '' AS chosen UNION ALL SELECT x FROM (VALUES ('a'), ('b'), ('c'), ('a+b'), ('a+c'), ('b+c'), ('a+b+c')) t(x)")
def _(m: Star) -> DataFrame:
    return m.spark.createDataFrame([("+".join(c),) for c in blocks.set_combinations(["a", "b", "c"])], "chosen string")


@query("sink_reports", "SELECT 'blocks' AS report, block AS key, count(*) AS n FROM blocks GROUP BY ALL UNION ALL SELECT 'runs', run_id::VARCHAR, n_clusters FROM runs")
def _(m: Star) -> DataFrame:
    """Two reports, written with their heads and read again."""
    path = fresh_path(m.spark, "reports")
    sinks.reports({"blocks": m.blocks.groupBy("block").agg(F.count("*").alias("n")), "runs": m.runs.select("run_id", "n_clusters")}, path)
    blocks_, runs = (m.spark.read.csv(f"{path}/{name}", header=True) for name in ("blocks", "runs"))
    one = blocks_.select(F.lit("blocks").alias("report"), F.col("block").alias("key"), F.col("n").cast("long").alias("n"))
    return one.unionByName(runs.select(F.lit("runs").alias("report"), F.col("run_id").alias("key"), F.col("n_clusters").cast("long").alias("n")))


@query("sink_edge_list", "SELECT a, b, round(weight, 6) AS weight FROM edges", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    path = fresh_path(m.spark, "edges")
    sinks.edge_list(edges_of(m), path)
    return m.spark.read.schema("a long, b long, weight double").csv(path, sep="\t").withColumn("weight", F.round("weight", 6))


@query("sink_community_files", f"""{LINKED_SQL.strip()} SELECT 'wpairs' AS file, count(*) AS n, sum(a)::BIGINT AS ids FROM edges UNION ALL SELECT 'tanimoto', count(*), sum(keystone)::BIGINT FROM sim
UNION ALL SELECT 'clusters', count(*), sum(community)::BIGINT FROM labelled UNION ALL SELECT 'density', count(*), sum(communities)::BIGINT FROM densities UNION ALL SELECT 'communities', count(*), sum(corem_id)::BIGINT FROM corem_edges
UNION ALL SELECT 'corem_rows', count(*), sum(row_id)::BIGINT FROM corem_rows""", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    """All files of the communities, and the four corem tables, written and read again: rows and the sum of an id of each."""
    path, edges = fresh_path(m.spark, "communities"), cut(edges_of(m))
    similarity = cut(graph.edge_similarity(edges))
    labelled = cut(communities.link_communities(edges, similarity, THRESHOLDS))
    densities = cut(communities.partition_densities(communities.community_stats(labelled)))
    kept = cut(communities.corems(labelled.filter(F.col("threshold") == THRESHOLDS[0])))
    sinks.community_files(edges, similarity, labelled, densities, kept, path)
    sinks.save_communities(kept, kept.select("corem_id", F.col("a").alias("col_id"), F.lit(0.5).alias("pval")).distinct(), f"{path}/tables")
    # Where the id stands, out of how many columns; named, as a file without rows has none to be found in it.
    places = {"wpairs": (0, 3), "tanimoto": (0, 4), "clusters": (1, 5), "density": (5, 9), "communities": (0, 6)}
    out = m.spark.read.parquet(f"{path}/tables/corem_rows").agg(F.count("*").alias("n"), F.sum("row_id").cast("long").alias("ids")).select(F.lit("corem_rows").alias("file"), "n", "ids")
    for name, (at, width) in places.items():
        read = m.spark.read.schema(", ".join(f"_c{k} string" for k in range(width))).csv(f"{path}/{name}", sep="\t")
        out = out.unionByName(read.agg(F.count("*").alias("n"), F.sum(F.col(f"_c{at}").cast("double")).cast("long").alias("ids")).select(F.lit(name).alias("file"), "n", "ids"))
    return out
