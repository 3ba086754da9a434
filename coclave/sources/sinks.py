"""What is written out: model tables, tracks, motif texts, sub-matrices, reports, community files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.operators.corem import edge_key
from coclave.operators.motif import meme_blocks, meme_header
from coclave.operators.number import in_order


def numbered(names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(key, name): distinct names with numbers from 1 in their order, the same whatever the partitions."""
    return in_order(names.select(name).distinct(), [name], key, 1).select(key, name)


def expression_table(long: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(row_id, col_id, raw, std) from (row, col, raw, std) and the numbered names."""
    by_row, by_col = rows.select("row_id", F.col("name").alias("row")), cols.select("col_id", F.col("name").alias("col"))
    return long.join(by_row, "row").join(by_col, "col").select("row_id", "col_id", "raw", "std")


def save(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, in folders by `partition`. With mode 'overwrite' only the partitions that df has are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, and those of old whose keys new does not have."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def save_communities(corem_edges: DataFrame, corem_cols: DataFrame, path: str) -> None:
    """Four tables: corems, their rows, their edges as "a-b" from the lesser end on, and their columns with p-values."""
    save(corem_edges.select("corem_id", "density", "weighted_density").distinct(), f"{path}/corems", mode="overwrite")
    save(corem_edges.select("corem_id", F.explode(F.array("a", "b")).alias("row_id")).distinct(), f"{path}/corem_rows", mode="overwrite")
    save(corem_edges.select("corem_id", edge_key(F.col("a"), F.col("b")).alias("edge")), f"{path}/corem_edges", mode="overwrite")
    save(corem_cols.select("corem_id", "col_id", "pval"), f"{path}/corem_cols", mode="overwrite")


def community_files(edges: DataFrame, similarity: DataFrame, labelled: DataFrame, densities: DataFrame, corem_edges: DataFrame, path: str) -> None:
    """What community tools hand on, each as tab-separated text in a folder: pairs, similarity, clusters of each cut, densities, communities."""
    text = lambda df, name: df.write.csv(f"{path}/{name}", sep="\t")
    text(edges.select("a", "b", "weight"), "wpairs")
    text(similarity.select("keystone", "i", "j", "similarity"), "tanimoto")
    text(labelled.select("threshold", "community", "a", "b", "weight"), "clusters")
    text(densities.select("threshold", "edges", "d1", "edges_ns", "d2", "communities", "d5", "d3", "d4"), "density")
    text(corem_edges.select("corem_id", "a", "b", "weight", "density", "weighted_density"), "communities")


def browser_track(depth: DataFrame, chromosome: str, path: str) -> None:
    """A tab-separated track per gre_id from (gre_id, position, depth): start, end, strand, chr, value."""
    rows = depth.select(
        F.concat(F.lit("GRE_"), F.col("gre_id").cast("string")).alias("id"), F.col("position").alias("start"), F.col("position").alias("end"),
        F.lit("+").alias("strand"), F.lit(chromosome).alias("chr"), F.col("depth").alias("value"),
    )
    rows.repartition("id").sortWithinPartitions("id", "start").write.partitionBy("id").csv(path, sep="\t", header=True)


def module_track(genes: DataFrame, chromosome: str, path: str) -> None:
    """gene, chr, start, stop."""
    genes.select("gene", F.lit(chromosome).alias("chr"), "start", "stop").orderBy("start", "gene").write.csv(path, sep="\t", header=True)


def meme_text(pwm: DataFrame, by: list[str], path: str, exported: DataFrame | None = None, name: Column | None = None) -> None:
    """A header, then one text block per motif in order of their keys; the first part file begins with the header."""
    blocks = meme_blocks(pwm, by, exported, name).select(F.lit(1).alias("__part"), *by, F.concat("block", F.lit("\n")).alias("value"))
    head = pwm.sparkSession.range(1).select(F.lit(0).alias("__part"), *(F.lit(None).cast(pwm.schema[c].dataType).alias(c) for c in by), F.lit(meme_header()).alias("value"))
    head.unionByName(blocks).orderBy("__part", *by).select("value").write.text(path)


def sites_fasta(sites: DataFrame, path: str, padding: int = 20) -> None:
    """(name, site) as FASTA, each site between `padding` N."""
    n = F.repeat(F.lit("N"), F.lit(padding))
    sites.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), n, F.col("site"), n).alias("value")).write.text(path)


def sub_matrix(cells: DataFrame, cols: list[str], path: str, row: str = "row", col: str = "col", value: str = "raw") -> None:
    """The chosen columns as a wide tab-separated file with row names first."""
    wide = cells.filter(F.col(col).isin(cols)).groupBy(row).pivot(col, sorted(cols)).agg(F.first(value))
    wide.orderBy(row).write.csv(path, sep="\t", header=True)


def reports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as one CSV with a header, in a folder of its name; reports have a row per block or run."""
    for name, table in tables.items():
        table.coalesce(1).write.csv(f"{path}/{name}", header=True)


def edge_list(edges: DataFrame, path: str) -> None:
    """a, b, weight by tabs."""
    edges.select("a", "b", "weight").write.csv(path, sep="\t")
