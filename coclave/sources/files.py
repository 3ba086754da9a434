"""Readers of the files that ensembles come in. All read whole directories or globs in parallel; compressed text is read as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coclave.operators.expression import missing_to_null, to_long, zscore
from coclave.operators.number import in_place


def ratios(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, raw, std) from a matrix with a header and row names first: tab-separated, or by commas if tabs give one column.

    ValueError if neither does. NaN and empty cells are null and stay in the rows' places.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    if len(wide.columns) == 1:
        wide = spark.read.csv(path, sep=",", header=True)
    if len(wide.columns) == 1:
        raise ValueError(f"no columns in {path}")
    row = wide.columns[0]
    values = wide.select(F.col(f"`{row}`").alias("row"), *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in wide.columns[1:]))
    return zscore(missing_to_null(to_long(values, "row", "col", "raw"), "raw"), "row", "raw", "std")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(refseq, header, sequence): the second word of a header names the sequence; its lines are joined, in upper case."""
    records = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    header = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substr("value", F.length(header) + 1), r"\s", "")
    words = F.split(F.trim(header), r"\s+")
    return records.select(F.coalesce(F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("refseq"), F.trim(header).alias("header"), F.upper(body).alias("sequence"))


def annotations(spark: SparkSession, path: str, known: DataFrame, name: str = "sysName") -> DataFrame:
    """(name, annotation, value) from a wide tab-separated file, for rows whose name column is in known (name); blanks are left out."""
    wide = spark.read.csv(path, sep="\t", header=True)
    kept = wide.filter(F.col(name).isNotNull()).join(known.select(F.col(known.columns[0]).alias(name)).distinct(), name, "left_semi")
    long = to_long(kept.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns)), name, "annotation", "value")
    return long.filter(F.trim("value") != "").withColumnRenamed(name, "name")


def fimo(spark: SparkSession, path: str, max_p: float = 1e-5, pattern: str = r"(\d+)\D*$") -> DataFrame:
    """Hits from tab-separated scans, one file per cluster: the cluster's number is in the file's name.

    in_coding_rgn is null where the file has no such column. The contig is the last two parts, by underscore, of the last but
    one dotted part of the sequence name, where it has dots.
    """
    raw = spark.read.csv(path, sep="\t", header=True).withColumn("__file", F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"(\.(tsv|txt))?(\.(gz|bz2))?$", ""))
    by = {c.lstrip("#").strip().lower(): c for c in raw.columns}
    col = lambda c: F.col(f"`{by[c]}`")
    flag = F.expr(f"try_cast(`{by['in_coding_rgn']}` as boolean)") if "in_coding_rgn" in by else F.lit(None).cast("boolean")
    return raw.select(
        F.regexp_extract("__file", pattern, 1).cast("int").alias("cluster"),
        col("pattern name").cast("int").alias("motif_num"),
        contig_of(col("sequence name")).alias("contig"),
        col("start").cast("int").alias("start"),
        col("stop").cast("int").alias("stop"),
        col("strand").alias("strand"),
        col("score").cast("double").alias("score"),
        col("p-value").cast("double").alias("pvalue"),
        flag.alias("in_coding_rgn"),
    ).filter(F.col("pvalue") <= max_p)


def contig_of(name: object) -> object:
    parts = F.split(name, r"\.")
    inner = F.split(F.get(parts, F.size(parts) - 2), "_")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(inner, F.greatest(F.size(inner) - 1, F.lit(1)), 2), "_")).otherwise(name)


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of one text file, numbered from 0 in file order; the numbering follows the file's splits, which are in order."""
    return in_place(spark.read.text(path), "pos").select("pos", F.col("value").alias("line"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(type, contig, start_pos, end_pos) after the line that has the word header; no SEQ_END; '<' and '>' leave positions."""
    lines = lines_in_order(spark, path)
    head = lines.filter(F.col("line").contains("header")).agg(F.min("pos").alias("head"))
    names = lines.crossJoin(F.broadcast(head)).filter("head is null or pos > head")
    first = [x.lstrip("-# ").strip() for x in (names.orderBy("pos").limit(1).collect() or [{"line": ""}])[0]["line"].split("\t")]
    at = {n: first.index(n) for n in ("type", "contig", "start_pos", "end_pos") if n in first}
    if len(at) < 4:
        raise ValueError(f"no feature columns in {path}")
    part = lambda n: F.get(F.split("line", "\t"), F.lit(at[n]))
    position = lambda n: F.regexp_replace(part(n), "[<>]", "").try_cast("int")
    rows = names.select(part("type").alias("type"), part("contig").alias("contig"), position("start_pos").alias("start_pos"), position("end_pos").alias("end_pos"))
    return rows.filter("type <> 'SEQ_END' and start_pos is not null and end_pos is not null")


def motif_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, target, pvalue, overlap, consensus of both) from tab-separated comparisons, one or many files."""
    raw = spark.read.csv(path, sep="\t", header=True)
    by = {c.lstrip("#").strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    return raw.select(
        by["query id"].alias("query"), by["target id"].alias("target"), by["p-value"].cast("double").alias("pvalue"), by["overlap"].cast("int").alias("overlap"),
        by.get("query consensus", F.lit(None).cast("string")).alias("query_consensus"), by.get("target consensus", F.lit(None).cast("string")).alias("target_consensus"),
    )


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(sample, block), trimmed."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.trim(f"`{c}`").alias(c.strip()) for c in raw.columns))


def run_table(spark: SparkSession, folders: dict[str, str], table: str, finished: str | None = "run_infos") -> DataFrame:
    """A table of every run as one, with run_id; runs whose run_infos has no finish_time are left out.

    folders: run_id to a folder of one Parquet table per name.
    """
    parts = [spark.read.parquet(f"{folder}/{table}").withColumn("run_id", F.lit(run)) for run, folder in folders.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    if finished is None or table == finished:
        return whole.filter(F.col("finish_time").isNotNull()) if table == finished else whole
    done = run_table(spark, folders, finished).select("run_id").distinct()
    return whole.join(done, "run_id", "left_semi")


def last_iteration(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the last iteration, of each run where `by` names it."""
    by = by or []
    last = table.groupBy(*by).agg(F.max("iteration").alias("__last"))
    # Without `by` it is one row; else a row per group, which the planner broadcasts only if it is small.
    joined = table.join(last, by) if by else table.crossJoin(F.broadcast(last))
    return joined.filter("iteration = __last").drop("__last")


def scan_table(spark: SparkSession, folders: dict[str, str], max_p: float = 1e-5) -> DataFrame:
    """The scans of every run as one table with run_id, to be saved in folders by it; folders: run_id to a path or glob of scans."""
    whole = None
    for run, path in folders.items():
        part = fimo(spark, path, max_p).withColumn("run_id", F.lit(run))
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        raise ValueError("no runs")
    return whole


def with_cluster_ids(scans: DataFrame, biclusters: DataFrame, runs: DataFrame) -> DataFrame:
    """Scans (dirname, cluster, ...) with the cluster_id that the run of that directory has for that number; others are left out."""
    known = biclusters.join(runs.select("run_id", "dirname"), "run_id").select("dirname", F.col("cluster_num").alias("cluster"), "cluster_id")
    return scans.join(known, ["dirname", "cluster"])


def organism_code(infos: DataFrame) -> str | None:
    """The code of the first run that has one."""
    first = infos.filter(F.col("ncbi_code").isNotNull()).select(F.col("ncbi_code").cast("string").alias("code")).limit(1).collect()
    return first[0]["code"] if first else None


def ensembles(runs: DataFrame) -> DataFrame:
    """(organism, species): the first species by name of each organism that has runs."""
    return runs.groupBy("organism").agg(F.min("species").alias("species"))
