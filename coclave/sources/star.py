"""The ensemble model over a star schema: orders are groups, parts are rows, suppliers are columns.

Every table is a lazy DataFrame, so a query scans only the columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coclave.runtime import ready


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return ready(self.spark).read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def members(self) -> DataFrame:
        """bc_rows as it is stored, with its repeated rows."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("row_id"))

    @cached_property
    def bc_rows(self) -> DataFrame:
        return self.members.distinct()

    @cached_property
    def bc_cols(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("col_id")).distinct()

    @cached_property
    def biclusters(self) -> DataFrame:
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("cluster_id"), (F.col("o_orderkey") % 20).alias("run_id"), F.col("o_orderkey").alias("cluster_num"), F.col("o_totalprice").alias("residual")
        )
        return orders.join(self.raw("lineitem").select(F.col("l_orderkey").alias("cluster_id")), "cluster_id", "left_semi")

    @cached_property
    def row_info(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sys_name"), F.col("p_brand").alias("group_name")
        )

    @cached_property
    def col_info(self) -> DataFrame:
        placed = (
            self.raw("supplier")
            .join(self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"), "s_nationkey")
            .join(self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
        )
        note = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"), F.lit(None).cast("string").alias("units"))
        return placed.select(F.col("s_suppkey").alias("col_id"), F.col("s_name").alias("name"), F.array(note("nation", "n_name"), note("region", "r_name")).alias("annotations"))

    @cached_property
    def expr(self) -> DataFrame:
        value = F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))
        return self.raw("lineitem").groupBy(F.col("l_partkey").alias("row_id"), F.col("l_suppkey").alias("col_id")).agg(F.avg(value).alias("raw"))

    @cached_property
    def motifs(self) -> DataFrame:
        brands = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.expr("cast(substr(p_brand, 7) as int)").alias("gre"))
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(brands, "l_partkey")
        return lines.groupBy(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").cast("int").alias("motif_num")).agg(
            (F.min("l_discount") + 0.0).alias("evalue"), F.min("gre").alias("gre_id")
        )

    @cached_property
    def hits(self) -> DataFrame:
        start = F.floor(F.col("value") * 10).cast("int")
        return self.raw("events").select(
            F.col("user_id").alias("cluster_id"),
            (F.col("event_id") % 3 + 1).cast("int").alias("motif_num"),
            F.col("event_type").alias("contig"),
            start.alias("start"),
            (start + 5 + F.col("event_id") % 20).cast("int").alias("stop"),
            ((F.col("event_id") % 1000) / 1000.0).alias("pvalue"),
            F.col("event_id").alias("hit_id"),
        )

    @cached_property
    def features(self) -> DataFrame:
        start = F.floor(F.median("value") * 10).cast("int")
        placed = self.raw("events").groupBy(F.col("event_type").alias("contig"), "user_id").agg(start.alias("start_pos"))
        return placed.select("contig", "start_pos", (F.col("start_pos") + 40).alias("end_pos"))

    @cached_property
    def pwm(self) -> DataFrame:
        letters = ["a", "c", "g", "t"]
        rows = self.raw("embeddings").select(
            F.col("vec_id").alias("motif_id"), F.col("label").alias("gre_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v")
        ).select("motif_id", "gre_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("row"), "v")
        at = [F.get("v", F.col("row") * 4 + k) for k in range(4)]
        return rows.select("motif_id", "gre_id", "row", *(x.alias(c) for x, c in zip(at, letters, strict=True))).select(
            "motif_id", "gre_id", "row", *((F.col(c) / (F.col("a") + F.col("c") + F.col("g") + F.col("t"))).alias(c) for c in letters)
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.raw("orders").groupBy((F.col("o_orderkey") % 20).alias("run_id")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("finish"), F.count("*").alias("n_clusters"))

    @cached_property
    def blocks(self) -> DataFrame:
        return self.raw("supplier").join(self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"), "s_nationkey").select(
            F.col("s_name").alias("sample"), F.col("s_suppkey").alias("col_id"), F.col("n_name").alias("block"), F.col("n_regionkey").alias("group_id")
        )


#: The same tables as SQL, for the oracles.
MODEL_SQL = """
bc_rows AS (SELECT DISTINCT l_orderkey AS cluster_id, l_partkey AS row_id FROM lineitem),
bc_cols AS (SELECT DISTINCT l_orderkey AS cluster_id, l_suppkey AS col_id FROM lineitem),
biclusters AS (SELECT o_orderkey AS cluster_id, o_orderkey % 20 AS run_id, o_orderkey AS cluster_num, o_totalprice AS residual FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
row_info AS (SELECT p_partkey AS row_id, p_name AS name, 'P' || p_partkey AS sys_name, p_brand AS group_name FROM part),
col_info AS (SELECT s_suppkey AS col_id, s_name AS name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
expr AS (SELECT l_partkey AS row_id, l_suppkey AS col_id, avg(l_extendedprice / l_quantity * (1 - l_discount)) AS raw FROM lineitem GROUP BY ALL),
motifs AS (SELECT l_orderkey AS cluster_id, l_linenumber::INT AS motif_num, min(l_discount) + 0.0 AS evalue, min(substr(p_brand, 7)::INT) AS gre_id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
hits AS (SELECT user_id AS cluster_id, (event_id % 3 + 1)::INT AS motif_num, event_type AS contig, floor(value * 10)::INT AS start, (floor(value * 10) + 5 + event_id % 20)::INT AS stop, (event_id % 1000) / 1000.0 AS pvalue, event_id AS hit_id FROM events),
features AS (SELECT event_type AS contig, floor(median(value) * 10)::INT AS start_pos, floor(median(value) * 10)::INT + 40 AS end_pos FROM events GROUP BY event_type, user_id),
pwm AS (SELECT motif_id, gre_id, r AS row, a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t FROM (
  SELECT vec_id AS motif_id, label AS gre_id, r::INT AS r, abs(embedding[4 * r + 1]::DOUBLE) AS a, abs(embedding[4 * r + 2]::DOUBLE) AS c, abs(embedding[4 * r + 3]::DOUBLE) AS g, abs(embedding[4 * r + 4]::DOUBLE) AS t
  FROM embeddings, range(16) AS x(r))),
runs AS (SELECT o_orderkey % 20 AS run_id, min(o_orderdate) AS start, max(o_orderdate) AS finish, count(*) AS n_clusters FROM orders GROUP BY 1),
blocks AS (SELECT s_name AS sample, s_suppkey AS col_id, n_name AS block, n_regionkey AS group_id FROM supplier JOIN nation ON n_nationkey = s_nationkey)
"""
