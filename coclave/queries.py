"""One callable per operator of the library itself, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coclave.functions.stats import neg_log10, uniform, uniform_sql
from coclave.operators import blocks, communities, corem, enrich, expression, graph, interval, motif, names, resample, select
from coclave.operators.number import in_order
from coclave.plans.agglom import agglom
from coclave.plans.assemble import corem_columns
from coclave.plans.corem_info import Corems, corem_info
from coclave.plans.find_scans import find_scans
from coclave.runtime import cut, fresh_path
from coclave.sources.files import last_iteration, with_cluster_ids
from coclave.sources.sinks import upsert
from coclave.sources.star import MODEL_SQL, Star
from coclave.sources.versioned import Versioned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROWS, PAIR, COLS, GRES, CLUSTERS = [1, 2, 3], [260, 625], [1, 2], [11, 12], [1, 2, 3, 4, 5]
BACKBONE = 0.2
#: The cuts that the SQL states; the corems there are those of the first. The queries named _sweep go over all of SWEEP.
THRESHOLDS = [0.2, 0.3]
SWEEP = communities.THRESHOLDS


def query(name: str, sql: str | None, model: str = MODEL_SQL) -> Callable[[Callable[[Star], DataFrame]], Callable[[Star], DataFrame]]:
    """Register a query over the model; sql follows the model's common tables and begins with more of them or with SELECT."""

    def register(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Star(spark, folder))
        if sql is not None:
            head = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
            body = sql.replace("RECURSIVE ", "").strip()
            ORACLES[name] = f"{head} {model.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
        return build

    return register


def _list(values: list) -> str:
    return ", ".join(map(str, values))


# Selections

BRIDGES = {"row": ("bc_rows", "row_id"), "col": ("bc_cols", "col_id")}


def selection_sql(kind: str, wanted: list, logic: str) -> str:
    """cluster_id of the chosen groups."""
    if kind == "gre":
        test = {"or": f"gre_id IN ({_list(wanted)})", "nor": f"gre_id NOT IN ({_list(wanted)})", "and": f"gre_id = {wanted[0]}" if len(set(wanted)) == 1 else "false"}[logic]
        return f"SELECT DISTINCT cluster_id FROM biclusters SEMI JOIN (SELECT cluster_id FROM motifs WHERE {test}) USING (cluster_id)"
    if kind == "cluster":
        return f"SELECT cluster_id FROM biclusters WHERE cluster_id {'NOT ' if logic == 'nor' else ''}IN ({_list(wanted)})"
    table, member = BRIDGES[kind]
    if logic == "and":
        return f"SELECT cluster_id FROM {table} WHERE {member} IN ({_list(wanted)}) GROUP BY 1 HAVING count(DISTINCT {member}) = {len(set(wanted))}"
    return f"SELECT cluster_id FROM biclusters WHERE cluster_id {'NOT ' if logic == 'nor' else ''}IN (SELECT cluster_id FROM {table} WHERE {member} IN ({_list(wanted)}))"


for _name, _kind, _wanted, _logic in (
    ("select_or", "row", ROWS, "or"), ("select_and", "row", PAIR, "and"), ("select_nor", "row", ROWS, "nor"), ("select_cols_and", "col", COLS, "and"),
):

    @query(_name, f"SELECT b.cluster_id, b.run_id, b.residual FROM biclusters b WHERE cluster_id IN ({selection_sql(_kind, _wanted, _logic)})")
    def _(m: Star, kind: str = _kind, wanted: list = _wanted, logic: str = _logic) -> DataFrame:
        table, member = BRIDGES[kind]
        return select.members(m.biclusters, getattr(m, table), member, wanted, logic).select("cluster_id", "run_id", "residual")


for _logic in ("or", "and", "nor"):

    @query(f"select_gre_{_logic}", f"SELECT cluster_id, motif_num, gre_id FROM motifs WHERE {dict(zip(('or', 'and', 'nor'), (f'gre_id IN ({_list(GRES)})', 'false', f'gre_id NOT IN ({_list(GRES)})'), strict=True))[_logic]}")
    def _(m: Star, logic: str = _logic) -> DataFrame:
        return select.scalar(m.motifs, "gre_id", GRES, logic).select("cluster_id", "motif_num", "gre_id")


@query("select_composed_name", "SELECT cluster_id, motif_num, gre_id FROM motifs WHERE (cluster_id = 1 AND motif_num = 1) OR (cluster_id = 5 AND motif_num = 2)")
def _(m: Star) -> DataFrame:
    return select.by_composed_name(m.motifs, ["1_1", "5_2"], ["cluster_id", "motif_num"]).select("cluster_id", "motif_num", "gre_id")


@query("find_match", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'n_nationkey' ELSE 'n_regionkey' END AS \"column\" FROM nation WHERE n_nationkey = 3 OR n_regionkey = 3 ORDER BY n_nationkey LIMIT 1")
def _(m: Star) -> DataFrame:
    return select.first_match_column(m.raw("nation"), ["n_nationkey", "n_regionkey"], "n_nationkey", 3)


@query("annotation_exists", "SELECT col_id, name FROM col_info WHERE n_name = (SELECT min(n_name) FROM nation)")
def _(m: Star) -> DataFrame:
    first = m.raw("nation").agg(F.min("n_name")).first()[0]
    return select.has_annotation(m.col_info, "annotations", "nation", first).select("col_id", "name")


@query("annotation_regex", "SELECT col_id, name FROM col_info WHERE regexp_matches(r_name, '^A')")
def _(m: Star) -> DataFrame:
    return select.has_annotation(m.col_info, "annotations", "region", regex="^A").select("col_id", "name")


# Counts and enrichment

for _name, _table, _member in (("count_rows", "bc_rows", "row_id"), ("count_cols", "bc_cols", "col_id"), ("count_gres", "motifs", "gre_id")):

    @query(_name, f"SELECT {_member} AS key, count(*) AS counts FROM {_table} GROUP BY 1")
    def _(m: Star, table: str = _table, member: str = _member) -> DataFrame:
        return enrich.counts(getattr(m, table), member)


LOG_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


def enrichment_sql(bridge: str, member: str, selected: str, drawn_rows: bool = False, least: int = 0, cutoff: float = 0.05) -> str:
    term = f"exp({LOG_CHOOSE.format('n_all', 'i')} + {LOG_CHOOSE.format('(big - n_all)', '(drawn - i)')} - ({LOG_CHOOSE.format('big', 'drawn')}))"
    return f"""chosen AS ({selected}), inside AS (SELECT b.* FROM {bridge} b WHERE b.cluster_id IN (SELECT cluster_id FROM chosen)),
own AS (SELECT {member} AS key, count(*) AS counts FROM inside GROUP BY 1), everywhere AS (SELECT {member} AS key, count(*) AS all_counts FROM {bridge} GROUP BY 1),
sized AS (SELECT key, counts, all_counts, all_counts::DOUBLE AS n_all, (SELECT count(*) FROM biclusters)::DOUBLE AS big, (SELECT count(*) FROM {'inside' if drawn_rows else 'chosen'})::DOUBLE AS drawn
  FROM own JOIN everywhere USING (key) WHERE all_counts >= {least}),
tested AS (SELECT key, counts, all_counts, CASE WHEN counts >= least(n_all, drawn) THEN 0.0 ELSE
  least(1.0, list_sum(list_transform(range(greatest(counts + 1, (n_all + drawn - big)::BIGINT, 0), least(n_all, drawn)::BIGINT + 1), lambda i: {term}))) END AS pval FROM sized),
ranked AS (SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY pval, key) AS place FROM tested),
fixed AS (SELECT *, least(1.0, min(pval * tests / place) OVER (ORDER BY place DESC ROWS UNBOUNDED PRECEDING)) AS bh, least(1.0, pval * tests) AS bonferroni FROM ranked)
SELECT key, counts, all_counts, {', '.join(f'round(-log10(greatest({p}, 1e-300)), 4) + 0.0 AS {out}' for p, out in (('pval', 'pval_log'), ('bh', 'qval_bh_log'), ('bonferroni', 'qval_bonferroni_log')))}
FROM fixed WHERE pval <= {cutoff}"""


def logged(done: DataFrame) -> DataFrame:
    return done.select("key", "counts", "all_counts", *(neg_log10(F.col(p)).alias(f"{p}_log") for p in ("pval", "qval_bh", "qval_bonferroni")))


Y = {"row": ("bc_rows", "row_id"), "col": ("bc_cols", "col_id"), "gre": ("motifs", "gre_id")}
for _name, _x, _wanted, _y, _logic in (
    ("agglom_rows_rows_or", "row", ROWS, "row", "or"), ("agglom_rows_rows_and", "row", PAIR, "row", "and"), ("agglom_rows_rows_nor", "row", ROWS, "row", "nor"),
    ("agglom_rows_cols_or", "row", ROWS, "col", "or"), ("agglom_rows_gre_or", "row", ROWS, "gre", "or"), ("agglom_cols_rows_and", "col", COLS, "row", "and"),
    ("agglom_cols_cols_or", "col", COLS, "col", "or"), ("agglom_cols_gre_nor", "col", COLS, "gre", "nor"), ("agglom_gre_rows_or", "gre", GRES, "row", "or"),
    ("agglom_gre_cols_or", "gre", GRES, "col", "or"), ("agglom_gre_gre_nor", "gre", GRES, "gre", "nor"), ("agglom_cluster_rows", "cluster", CLUSTERS, "row", "or"),
):

    @query(_name, enrichment_sql(*Y[_y], selection_sql(_x, _wanted, _logic), _y == "gre", 10 if _y == "gre" else 0, 1.0 if _y == "gre" else 0.05))
    def _(m: Star, x: str = _x, wanted: list = _wanted, y: str = _y, logic: str = _logic) -> DataFrame:
        return logged(agglom(m, wanted, x, y, logic=logic, pval_cutoff=1.0 if y == "gre" else 0.05))


def sets_sql(bridge: str, member: str, cutoff: float) -> str:
    """enrichment_sql over a table sets (set_id, row_id), with everything by set."""
    term = f"exp({LOG_CHOOSE.format('n_all', 'i')} + {LOG_CHOOSE.format('(big - n_all)', '(drawn - i)')} - ({LOG_CHOOSE.format('big', 'drawn')}))"
    return f"""sets AS (SELECT p_size AS set_id, p_partkey AS row_id FROM part), chosen AS (SELECT DISTINCT set_id, cluster_id FROM sets JOIN bc_rows USING (row_id)),
drawn AS (SELECT set_id, count(*)::DOUBLE AS drawn FROM chosen GROUP BY 1), everywhere AS (SELECT {member} AS key, count(*) AS all_counts FROM {bridge} GROUP BY 1),
own AS (SELECT set_id, {member} AS key, count(*) AS counts FROM chosen JOIN {bridge} USING (cluster_id) GROUP BY ALL),
sized AS (SELECT *, all_counts::DOUBLE AS n_all, (SELECT count(*) FROM biclusters)::DOUBLE AS big FROM own JOIN everywhere USING (key) JOIN drawn USING (set_id)),
tested AS (SELECT set_id, key, counts, all_counts, CASE WHEN counts >= least(n_all, drawn) THEN 0.0 ELSE
  least(1.0, list_sum(list_transform(range(greatest(counts + 1, (n_all + drawn - big)::BIGINT, 0), least(n_all, drawn)::BIGINT + 1), lambda i: {term}))) END AS pval FROM sized),
ranked AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS tests, row_number() OVER (PARTITION BY set_id ORDER BY pval, key) AS place FROM tested),
fixed AS (SELECT *, least(1.0, min(pval * tests / place) OVER (PARTITION BY set_id ORDER BY place DESC ROWS UNBOUNDED PRECEDING)) AS bh, least(1.0, pval * tests) AS bonferroni FROM ranked)
SELECT set_id, key, counts, all_counts, {', '.join(f'round(-log10(greatest({p}, 1e-300)), 4) + 0.0 AS {out}' for p, out in (('pval', 'pval_log'), ('bh', 'qval_bh_log'), ('bonferroni', 'qval_bonferroni_log')))}
FROM fixed WHERE pval <= {cutoff}"""


@query("enrichment_of_sets", sets_sql("bc_cols", "col_id", 0.05))
def _(m: Star) -> DataFrame:
    """All parts of one size as a set, every set against all columns in one plan."""
    sets = m.raw("part").select(F.col("p_size").alias("set_id"), F.col("p_partkey").alias("row_id"))
    done = enrich.enrichment_of_sets(sets, m.bc_rows, "row_id", "col_id", m.biclusters, target=m.bc_cols)
    return done.select("set_id", "key", "counts", "all_counts", *(neg_log10(F.col(p)).alias(f"{p}_log") for p in ("pval", "qval_bh", "qval_bonferroni")))


@query("agglom_rows_cluster", f"chosen AS ({selection_sql('row', ROWS, 'or')}) SELECT cluster_id, count(*) AS num_genes, string_agg(sys_name, ',' ORDER BY sys_name) AS genes FROM bc_rows JOIN row_info USING (row_id) WHERE cluster_id IN (SELECT cluster_id FROM chosen) GROUP BY 1")
def _(m: Star) -> DataFrame:
    return agglom(m, ["P1", "P2", "P3"], "genes", "bicluster", x_input_type="sys_name").withColumn("genes", F.array_join("genes", ","))


# Names

FIELDS = ["row_id", "name", "sys_name"]


@query("name_any", "SELECT row_id FROM row_info WHERE row_id IN (5, 7) OR name = (SELECT min(p_name) FROM part) OR sys_name = 'P9'")
def _(m: Star) -> DataFrame:
    first = m.raw("part").agg(F.min("p_name")).first()[0]
    return names.by_any_field(m.row_info, [5, 7, first, "P9"], FIELDS).select("row_id")


@query("name_all_fields", "SELECT row_id, name, sys_name, group_name FROM row_info WHERE sys_name IN ('P3', 'P4')")
def _(m: Star) -> DataFrame:
    return names.by_any_field(m.row_info, ["P3", "P4"], FIELDS)


@query("name_with_ordered", "SELECT * FROM (VALUES (0, 7::BIGINT), (1, 3::BIGINT), (2, 5::BIGINT)) t(pos, row_id)")
def _(m: Star) -> DataFrame:
    return names.by_field(m.row_info, ["P7", "P3", "P5", "P7"], "sys_name", "row_id")


@query("col_name_any", "SELECT col_id FROM col_info WHERE col_id IN (1, 3) UNION ALL SELECT col_id FROM col_info WHERE name = (SELECT min(s_name) FROM supplier)")
def _(m: Star) -> DataFrame:
    first = m.raw("supplier").agg(F.min("s_name")).first()[0]
    return names.by_any_field(m.col_info, [1, 3, first], ["col_id", "name"], distinct=False).select("col_id")


@query("genes_with_name", "SELECT row_id FROM row_info WHERE name = (SELECT max(p_name) FROM part)")
def _(m: Star) -> DataFrame:
    last = m.raw("part").agg(F.max("p_name")).first()[0]
    return m.row_info.filter(F.col("name") == last).select("row_id")


@query("name_first_kept", "SELECT name, min(row_id) AS row_id FROM row_info GROUP BY 1")
def _(m: Star) -> DataFrame:
    return names.keep_first(m.row_info.select("name", "row_id"), "name", "row_id")


# Matrices


@query("expr_long", "SELECT row_id, col_id, round(raw, 6) AS raw FROM expr")
def _(m: Star) -> DataFrame:
    return m.expr.select("row_id", "col_id", F.round("raw", 6).alias("raw"))


@query("expr_slice_pivot", "SELECT row_id, " + ", ".join(f"round(max(CASE WHEN col_id = {c} THEN raw END), 6) AS c{c}" for c in range(6)) + " FROM expr WHERE row_id BETWEEN 1 AND 200 AND col_id BETWEEN 0 AND 5 GROUP BY 1")
def _(m: Star) -> DataFrame:
    wide = expression.slice_wide(m.expr, list(range(1, 201)), list(range(6)))
    return wide.select("row_id", *(F.round(c, 6).alias(c) for c in wide.columns[1:]))


@query("expr_unpivot", "SELECT p_partkey AS row_id, 'p_size' AS col, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(m: Star) -> DataFrame:
    wide = m.raw("part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return expression.to_long(wide, "row_id")


@query("zscore_rows", "SELECT row_id, col_id, round((raw - avg(raw) OVER w) / nullif(stddev_samp(raw) OVER w, 0), 6) + 0.0 AS std FROM expr WINDOW w AS (PARTITION BY row_id)")
def _(m: Star) -> DataFrame:
    return expression.zscore(m.expr).select("row_id", "col_id", (F.round("std", 6) + 0.0).alias("std"))


@query("median_scale_rows", "s AS (SELECT row_id, median(raw) AS mid, round(stddev_samp(raw), 8) AS sd FROM expr GROUP BY 1) SELECT row_id, col_id, round((raw - mid) / nullif(sd, 0), 6) + 0.0 AS scaled FROM expr JOIN s USING (row_id)")
def _(m: Star) -> DataFrame:
    return expression.median_scale(m.expr).select("row_id", "col_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


@query("nochange_filter", """z AS (SELECT row_id, col_id, (raw - avg(raw) OVER w) / nullif(stddev_samp(raw) OVER w, 0) AS std FROM expr WINDOW w AS (PARTITION BY row_id)),
r AS (SELECT row_id FROM z GROUP BY 1 HAVING 1 - sum(CASE WHEN coalesce(abs(std) <= 0.17, true) THEN 0 ELSE 1 END) / (SELECT count(DISTINCT col_id) FROM z)::DOUBLE < 0.98),
c AS (SELECT col_id FROM z GROUP BY 1 HAVING 1 - sum(CASE WHEN coalesce(abs(std) <= 0.17, true) THEN 0 ELSE 1 END) / (SELECT count(DISTINCT row_id) FROM z)::DOUBLE < 0.8)
SELECT row_id, count(*) AS cells FROM z WHERE row_id IN (SELECT row_id FROM r) AND col_id IN (SELECT col_id FROM c) GROUP BY 1""")
def _(m: Star) -> DataFrame:
    return expression.drop_unchanging(expression.zscore(m.expr), value="std", col_share=0.8).groupBy("row_id").agg(F.count("*").alias("cells"))


@query("rsd_by_col", f"SELECT col_id, round(abs(stddev_pop(raw) / nullif(avg(raw), 0)), 6) AS rsd FROM expr WHERE row_id IN ({_list(list(range(100)))}) GROUP BY 1")
def _(m: Star) -> DataFrame:
    return expression.rsd_by_column(m.expr, list(range(100))).select("col_id", F.round("rsd", 6).alias("rsd"))


@query("percentile_limits", "p AS (SELECT quantile_cont(raw, 0.01) AS a, quantile_cont(raw, 0.99) AS b FROM expr) SELECT round(CASE WHEN a < 0 THEN -greatest(abs(a), abs(b)) ELSE a END, 6) AS low, round(CASE WHEN a < 0 THEN greatest(abs(a), abs(b)) ELSE b END, 6) AS high FROM p")
def _(m: Star) -> DataFrame:
    return expression.limits(m.expr).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("top_cols_by_mean", "SELECT col_id, round(avg(raw), 6) AS mean FROM expr GROUP BY 1")
def _(m: Star) -> DataFrame:
    return expression.columns_by_mean(m.expr).select("col_id", F.round("mean", 6).alias("mean"))


# Co-occurrence and its graph

GRAPH_SQL = MODEL_SQL.strip() + f""",
cooc AS (SELECT a.row_id AS src, b.row_id AS dst, count(*) AS counts FROM bc_rows a JOIN bc_rows b ON a.cluster_id = b.cluster_id AND a.row_id <> b.row_id GROUP BY ALL),
weighted AS (SELECT *, counts / sum(counts) OVER (PARTITION BY src) AS weight, count(*) OVER (PARTITION BY src) AS degree FROM cooc),
scored AS (SELECT *, pow(1 - weight, degree - 1) AS pval FROM weighted),
edges AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM scored WHERE pval <= {BACKBONE} GROUP BY ALL),
both_ways AS (SELECT a AS node, b AS other, weight AS w FROM edges UNION ALL SELECT b, a, weight FROM edges)"""


def similarity_sql(definition: int) -> str:
    own = "avg(w)" if definition == 0 else "1.0"
    return f"""near AS (SELECT * FROM both_ways UNION ALL SELECT node, node, {own} FROM both_ways GROUP BY 1),
dots AS (SELECT x.node AS i, y.node AS j, sum(x.w * y.w) AS dot FROM near x JOIN near y ON x.other = y.other AND x.node <= y.node GROUP BY ALL),
sim AS (SELECT x.node AS keystone, x.other AS i, y.other AS j, round(d.dot / (ni.dot + nj.dot - d.dot), 5) AS similarity
  FROM both_ways x JOIN both_ways y ON x.node = y.node AND x.other < y.other JOIN dots d ON d.i = x.other AND d.j = y.other
  JOIN dots ni ON ni.i = x.other AND ni.j = x.other JOIN dots nj ON nj.i = y.other AND nj.j = y.other)"""


def edges_of(m: Star) -> DataFrame:
    return graph.backbone(graph.backbone_pval(graph.weigh(graph.cooccurrence(m.members))), BACKBONE)


@query("cooccurrence", "SELECT src, dst, counts FROM cooc", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    return graph.cooccurrence(m.members)


@query("cooccur_weight", "SELECT src, dst, round(weight, 9) AS weight, degree FROM weighted", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    return graph.weigh(graph.cooccurrence(m.members)).select("src", "dst", F.round("weight", 9).alias("weight"), "degree")


@query("backbone_pval", "SELECT src, dst, round(pval, 6) AS pval FROM scored", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    return graph.backbone_pval(graph.weigh(graph.cooccurrence(m.members))).select("src", "dst", F.round("pval", 6).alias("pval"))


@query("backbone_edges", "SELECT a, b, round(weight, 9) AS weight FROM edges", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    return edges_of(m).select("a", "b", F.round("weight", 9).alias("weight"))


@query("wedge_count", "SELECT node, count(*) AS degree, count(*) * (count(*) - 1) // 2 AS wedges FROM both_ways GROUP BY 1", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    n = F.count("*")
    return graph.adjacency(edges_of(m)).groupBy("node").agg(n.alias("degree"), F.expr("count(*) * (count(*) - 1) div 2").alias("wedges"))


@query("inner_products", similarity_sql(0) + " SELECT i, j, round(dot, 9) AS dot FROM dots", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    return graph.inner_products(cut(edges_of(m))).select("i", "j", F.round("dot", 9).alias("dot"))


for _d in (0, 1):

    @query(f"tanimoto_def{_d}", similarity_sql(_d) + " SELECT keystone, i, j, similarity FROM sim", GRAPH_SQL)
    def _(m: Star, d: int = _d) -> DataFrame:
        return graph.edge_similarity(cut(edges_of(m)), d)


@query("tanimoto_from_cut", similarity_sql(0) + " SELECT keystone, i, j, similarity FROM sim WHERE similarity >= 0.3", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    """Pairs from a least similarity on, which bounds those that are made."""
    return graph.edge_similarity(cut(edges_of(m)), 0, 0.3)


LINKED_SQL = (
    similarity_sql(0)
    + f""",
named AS (SELECT *, row_number() OVER (ORDER BY a, b) - 1 AS edge FROM edges), cuts(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}),
links AS (SELECT t.threshold, x.edge AS src, y.edge AS dst FROM sim s JOIN cuts t ON s.similarity >= t.threshold
  JOIN named x ON x.a = least(keystone, i) AND x.b = greatest(keystone, i) JOIN named y ON y.a = least(keystone, j) AND y.b = greatest(keystone, j)),
mirrored AS (SELECT threshold, src, dst FROM links UNION ALL SELECT threshold, dst, src FROM links),
RECURSIVE reach AS (SELECT threshold, edge AS start, edge AS at FROM named, cuts UNION SELECT r.threshold, r.start, l.dst FROM reach r JOIN mirrored l ON l.threshold = r.threshold AND l.src = r.at),
labelled AS (SELECT r.threshold, n.a, n.b, n.weight, min(r.at) AS community FROM reach r JOIN named n ON n.edge = r.start GROUP BY ALL),
ends AS (SELECT threshold, community, a AS node FROM labelled UNION SELECT threshold, community, b FROM labelled),
stats AS (SELECT l.threshold, l.community, count(*) AS m, (SELECT count(*) FROM ends e WHERE e.threshold = l.threshold AND e.community = l.community) AS n, sum(weight) AS w FROM labelled l GROUP BY ALL),
parts AS (SELECT *, CASE WHEN n > 2 THEN (m - (n - 1)) / ((n - 2) * (n - 1)) ELSE 0 END AS f FROM stats),
densities AS (SELECT threshold, sum(m) AS edges, sum(CASE WHEN n <> 2 THEN m ELSE 0 END) AS edges_ns, count(*) AS communities, 2 * sum(m * f) / sum(m) AS d1,
  2 * sum(m * f) / nullif(sum(CASE WHEN n <> 2 THEN m ELSE 0 END), 0) AS d2, 2 * sum(w * f) / sum(w) AS d3, 2 * sum(w * f) / sum(m) AS d4, 2 * sum(w * w / m * f) / sum(w) AS d5 FROM parts GROUP BY 1),
best AS (SELECT threshold, d5 FROM densities ORDER BY round(d5, 12) DESC NULLS LAST, threshold LIMIT 1),
dense AS (SELECT *, CASE WHEN n = 2 THEN 0 ELSE (m - n + 1) / nullif(n * (n - 1) / 2 - n + 1, 0) END AS raw FROM stats WHERE threshold = {THRESHOLDS[0]}),
kept AS (SELECT *, round(raw, 5) AS density, round(round(w / m, 5) * raw, 5) AS weighted_density FROM dense WHERE m >= 3 AND round(raw, 5) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY density DESC, weighted_density DESC, community DESC) AS corem_id FROM kept),
corem_edges AS (SELECT k.corem_id, l.a, l.b, l.weight, k.density, k.weighted_density FROM numbered k JOIN labelled l USING (threshold, community)),
corem_rows AS (SELECT corem_id, a AS row_id FROM corem_edges UNION SELECT corem_id, b FROM corem_edges)
"""
)


def labelled_of(m: Star, thresholds: list[float]) -> DataFrame:
    edges = cut(edges_of(m))
    return cut(communities.link_communities(edges, graph.edge_links(edges, 0, min(thresholds)), thresholds))


def corems_of(m: Star, cuts: list[float]) -> DataFrame:
    """The corems of the best cut of SWEEP; of THRESHOLDS, as the SQL has it, those of the first."""
    if cuts == SWEEP:
        return cut(communities.corems(communities.at_best(labelled_of(m, SWEEP))))
    return cut(communities.corems(labelled_of(m, cuts[:1])))


def linked(name: str, sql: str) -> Callable[[Callable[[Star, list[float]], DataFrame]], Callable[[Star, list[float]], DataFrame]]:
    """Register a query over THRESHOLDS with its SQL, and as NAME_sweep over SWEEP without."""

    def register(build: Callable[[Star, list[float]], DataFrame]) -> Callable[[Star, list[float]], DataFrame]:
        query(name, f"{LINKED_SQL.strip()} {sql}", GRAPH_SQL)(lambda m: build(m, THRESHOLDS))
        query(f"{name}_sweep", None)(lambda m: build(m, SWEEP))
        return build

    return register


@linked("components_at_t", "SELECT threshold, a, b, community FROM labelled")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return labelled_of(m, cuts).select("threshold", "a", "b", "community")


@linked("community_stats", "SELECT threshold, community, m, n, round(w, 6) AS w FROM stats")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return communities.community_stats(labelled_of(m, cuts)).withColumn("w", F.round("w", 6))


DENSITY = [f"d{k}" for k in range(1, 6)]


@linked("partition_density", f"SELECT threshold, edges::BIGINT AS edges, edges_ns::BIGINT AS edges_ns, communities, {', '.join(f'round({d}, 8) AS {d}' for d in DENSITY)} FROM densities")
def _(m: Star, cuts: list[float]) -> DataFrame:
    done = communities.partition_densities(communities.community_stats(labelled_of(m, cuts)))
    return done.select("threshold", "edges", "edges_ns", "communities", *(F.round(d, 8).alias(d) for d in DENSITY))


@linked("best_threshold", "SELECT threshold, round(d5, 8) AS density FROM best")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return communities.best_threshold(communities.partition_densities(communities.community_stats(labelled_of(m, cuts)))).withColumn("density", F.round("density", 8))


@linked("communities", "SELECT corem_id, density, weighted_density, count(*) AS edges FROM corem_edges GROUP BY ALL")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return corems_of(m, cuts).groupBy("corem_id", "density", "weighted_density").agg(F.count("*").alias("edges"))


@linked("corems", "SELECT corem_id, row_id FROM corem_rows")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return communities.corem_rows(corems_of(m, cuts))


@linked("corem_genes", "SELECT sys_name AS gene FROM corem_rows JOIN row_info USING (row_id) WHERE corem_id = 1")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return corem.genes_of(communities.corem_rows(corems_of(m, cuts)), m.row_info, 1)


@linked("corems_with_genes", "picked AS (SELECT row_id FROM corem_rows WHERE corem_id = 1) SELECT corem_id, sys_name AS gene FROM corem_rows JOIN row_info USING (row_id) WHERE row_id IN (SELECT row_id FROM picked)".replace("picked AS", ", picked AS", 1))
def _(m: Star, cuts: list[float]) -> DataFrame:
    return corem.sharing_rows(cut(communities.corem_rows(corems_of(m, cuts))), m.row_info, 1)


@linked("corem_and_genes", ", wanted AS (SELECT row_id FROM corem_rows WHERE corem_id = 1 ORDER BY row_id LIMIT 2), chosen AS (SELECT corem_id FROM corem_rows WHERE row_id IN (SELECT row_id FROM wanted) GROUP BY 1 HAVING count(*) = 2) SELECT row_id, count(*) AS counts FROM corem_rows WHERE corem_id IN (SELECT corem_id FROM chosen) GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM chosen)")
def _(m: Star, cuts: list[float]) -> DataFrame:
    held = communities.corem_rows(corems_of(m, cuts))
    wanted = [r["row_id"] for r in held.filter("corem_id = 1").orderBy("row_id").limit(2).collect()]
    return corem.shared(held, "row_id", corem.choose(held, held, "row_id", wanted, "and"), "and")


@linked("corem_edges", "SELECT corem_id, x.sys_name || '-' || y.sys_name AS edge FROM corem_edges JOIN row_info x ON x.row_id = a JOIN row_info y ON y.row_id = b")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return corem.edge_names(corems_of(m, cuts), m.row_info)


@linked("corem_sizes", "SELECT DISTINCT count(*) AS size FROM corem_rows GROUP BY corem_id")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return corem.sizes(communities.corem_rows(corems_of(m, cuts)))


@linked("corem_lists", "SELECT corem_id, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS members FROM corem_rows GROUP BY 1")
def _(m: Star, cuts: list[float]) -> DataFrame:
    return communities.corem_lists(communities.corem_rows(corems_of(m, cuts))).select("corem_id", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("members"))


FIRST_EDGE = ", asked AS (SELECT a, b FROM corem_edges WHERE corem_id = 1 ORDER BY a, b LIMIT 1), chosen AS (SELECT DISTINCT corem_id FROM corem_edges JOIN asked USING (a, b))"


def known_corems(m: Star, cuts: list[float]) -> Corems:
    kept = corems_of(m, cuts)
    none = m.spark.createDataFrame([], "corem_id int, col_id long")
    return Corems(kept, cut(communities.corem_rows(kept)), none, m.row_info, m.col_info)


def first_edge(of: Corems) -> list[str]:
    """The first edge of corem 1 by its names, the other way round; nothing if there is no corem."""
    found = of.edges.filter("corem_id = 1").orderBy("a", "b").limit(1).select(F.expr("concat('P', b, '-P', a)").alias("edge")).collect()
    return [r["edge"] for r in found]


@linked("corem_info_of_edge", FIRST_EDGE + " SELECT sys_name AS genes, count(*) AS counts FROM corem_rows JOIN chosen USING (corem_id) JOIN row_info USING (row_id) GROUP BY 1")
def _(m: Star, cuts: list[float]) -> DataFrame:
    of = known_corems(m, cuts)
    edge = first_edge(of)
    return corem_info(of, edge, "edges", "genes", count=True) if edge else m.row_info.select(F.col("sys_name").alias("genes"), F.lit(0).cast("long").alias("counts")).limit(0)


@linked("corem_info_of_genes", FIRST_EDGE.split(", chosen")[0] + ", chosen AS (SELECT corem_id FROM corem_rows JOIN asked ON row_id IN (a, b) GROUP BY 1 HAVING count(*) = 2) SELECT x.sys_name || '-' || y.sys_name AS edges FROM corem_edges JOIN chosen USING (corem_id) JOIN row_info x ON x.row_id = a JOIN row_info y ON y.row_id = b")
def _(m: Star, cuts: list[float]) -> DataFrame:
    of = known_corems(m, cuts)
    edge = first_edge(of)
    return corem_info(of, edge[0].split("-"), "genes", "edges", logic="and") if edge else m.row_info.select(F.col("sys_name").alias("edges")).limit(0)


@query("corem_columns", None)
def _(m: Star) -> DataFrame:
    """All corems of the best cut against nulls of their own size, with the assembly's 1,000 draws."""
    held = cut(communities.corem_rows(corems_of(m, SWEEP)))
    return corem_columns(held, m.expr, 1000, 0.1, 0.05)


@query("upsert_edges", "changed AS (SELECT a, b, weight + 1 AS weight FROM edges WHERE a % 3 = 0 UNION ALL VALUES (-1::BIGINT, 1::BIGINT, 0.5::DOUBLE)) SELECT a, b, round(weight, 9) AS weight FROM changed UNION ALL SELECT a, b, round(weight, 9) FROM edges WHERE a % 3 <> 0", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    old = cut(edges_of(m)).select("a", "b", "weight")
    changed = old.filter("a % 3 = 0").withColumn("weight", F.col("weight") + 1).unionByName(m.spark.sql("SELECT -1L AS a, 1L AS b, 0.5D AS weight"))
    return upsert(old, changed, ["a", "b"]).withColumn("weight", F.round("weight", 9))


@query("upsert_edges_stored", "changed AS (SELECT a, b, weight + 1 AS weight FROM edges WHERE a % 3 = 0 UNION ALL VALUES (-1::BIGINT, 1::BIGINT, 0.5::DOUBLE)) SELECT a, b, round(weight, 9) AS weight FROM changed UNION ALL SELECT a, b, round(weight, 9) FROM edges WHERE a % 3 <> 0", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    """upsert_edges over a stored table, written back in place and read again; only parts with changed edges are written."""
    table = Versioned(m.spark, fresh_path(m.spark, "edges"), lambda: F.pmod("a", F.lit(12)))
    table.replace(edges_of(m).select("a", "b", "weight"))
    stored = table.read()
    changed = stored.filter("a % 3 = 0").withColumn("weight", F.col("weight") + 1).unionByName(m.spark.sql("SELECT -1L AS a, 1L AS b, 0.5D AS weight"))
    table.upsert(changed, ["a", "b"])
    return table.read().withColumn("weight", F.round("weight", 9))


@query("set_gre_ids_stored", "SELECT cluster_id, motif_num, CASE WHEN gre_id % 2 = 0 THEN gre_id + 100 ELSE gre_id END AS gre_id FROM motifs")
def _(m: Star) -> DataFrame:
    """New numbers for every second GRE, written over the stored motifs and read again."""
    table = Versioned(m.spark, fresh_path(m.spark, "motifs"), lambda: F.col("cluster_id") % 8)
    table.replace(m.motifs.select("cluster_id", "motif_num", "gre_id"))
    motifs = table.read()
    found = motifs.filter("gre_id % 2 = 0").withColumn("gre_id", F.col("gre_id") + 100)
    table.replace(motif.set_gre_ids(motifs, found))
    return table.read().select("cluster_id", "motif_num", "gre_id")


# Intervals


@query("stab_hits", "SELECT hit_id, cluster_id, motif_num FROM hits WHERE start <= 500 AND stop >= 500 AND pvalue <= 0.5")
def _(m: Star) -> DataFrame:
    return interval.stabbing(m.hits, 500, 0.5).select("hit_id", "cluster_id", "motif_num")


@query("contain_hits", "SELECT hit_id, start, stop FROM hits WHERE start >= 100 AND stop <= 900 AND contig = (SELECT min(event_type) FROM events)")
def _(m: Star) -> DataFrame:
    return interval.contained(m.hits, 100, 900, m.raw("events").agg(F.min("event_type")).first()[0]).select("hit_id", "start", "stop")


NAMED_HITS = "named AS (SELECT g.gre_id, h.contig, h.start, h.stop FROM hits h JOIN motifs g ON {} WHERE g.gre_id IS NOT NULL), spread AS (SELECT gre_id, contig, unnest(range(start, stop + 1)) AS position FROM named) SELECT gre_id, contig, position::INT AS position, count(*) AS depth FROM spread GROUP BY ALL"


@query("coverage_depth", NAMED_HITS.format("g.cluster_id = h.cluster_id"))
def _(m: Star) -> DataFrame:
    return interval.depth(interval.gre_hits(m.hits, m.motifs), ["gre_id", "contig"])


@query("coverage_depth_by_motif", NAMED_HITS.format("g.cluster_id = h.cluster_id AND g.motif_num = h.motif_num"))
def _(m: Star) -> DataFrame:
    return interval.depth(interval.gre_hits(m.hits, m.motifs, by_motif=True), ["gre_id", "contig"])


@query("gre_positions", f"SELECT gre_id, cluster_id, motif_num, contig, start, stop, pvalue FROM motifs JOIN hits USING (cluster_id, motif_num) WHERE gre_id IN ({_list(GRES)}) AND evalue < 0.08 AND pvalue < 0.9")
def _(m: Star) -> DataFrame:
    return interval.gre_positions(m.motifs, m.hits, GRES, 0.08, 0.9)


@query("hits_in_features", "SELECT hit_id, f.contig, f.start_pos, f.end_pos, count(*) AS n FROM hits h JOIN features f ON f.contig = h.contig AND f.start_pos <= h.start AND f.end_pos >= h.start GROUP BY ALL")
def _(m: Star) -> DataFrame:
    """Every pair of a hit's start and a feature that holds it, equal features as one with their number."""
    features = m.features.groupBy("contig", "start_pos", "end_pos").agg(F.count("*").alias("n"))
    found = interval.holding(m.hits.select("hit_id", "contig", "start"), "start", features, "start_pos", "end_pos")
    return found.select("hit_id", "contig", "start_pos", "end_pos", "n")


@query("stab_many", "p AS (SELECT DISTINCT contig, start_pos AS position FROM features) SELECT p.contig, position, hit_id FROM p JOIN hits h ON h.contig = p.contig AND h.start <= position AND h.stop >= position AND pvalue <= 0.05")
def _(m: Star) -> DataFrame:
    """The hits that hold any of many positions, in one join."""
    points = m.features.select("contig", F.col("start_pos").alias("position")).distinct()
    return interval.holding(points, "position", m.hits.filter("pvalue <= 0.05").select("hit_id", "contig", "start", "stop"), "start", "stop").select("contig", "position", "hit_id")


GENOME_SQL = "genome AS (SELECT contig AS scaffold, 'NC_' || contig AS refseq, max(stop) AS length FROM hits GROUP BY contig), locus AS (SELECT * FROM genome ORDER BY scaffold LIMIT 1)"


def genome_of(m: Star) -> DataFrame:
    return m.hits.groupBy(F.col("contig").alias("scaffold")).agg(F.max("stop").alias("length")).withColumn("refseq", F.concat(F.lit("NC_"), F.col("scaffold")))


@query("find_scans_track", f"""{GENOME_SQL}, inside AS (SELECT h.* FROM hits h JOIN locus ON contig = scaffold WHERE start >= 0 AND stop <= length AND pvalue <= 0.5),
spread AS (SELECT gre_id, unnest(range(start, stop + 1)) AS position FROM inside i JOIN (SELECT cluster_id, gre_id FROM motifs WHERE gre_id IN ({_list(GRES)})) g USING (cluster_id))
SELECT position AS start, position AS "end", '+' AS strand, (SELECT refseq FROM locus) AS chr, count(*) AS value, 'GRE_' || gre_id AS id FROM spread GROUP BY gre_id, position""")
def _(m: Star) -> DataFrame:
    """The whole of the first chromosome, named by its RefSeq name, for two GREs."""
    genome = cut(genome_of(m))
    locus = genome.agg(F.min("refseq")).first()[0]
    return find_scans(genome, m.hits, m.motifs, locus, gre_ids=GRES, max_p=0.5)


@query("find_scans_series", f"""{GENOME_SQL}, inside AS (SELECT h.* FROM hits h JOIN locus ON contig = scaffold WHERE start >= 100 AND stop <= 900)
SELECT gre_id, position, count(*) AS depth FROM (SELECT gre_id, unnest(range(start, stop + 1)) AS position FROM inside JOIN (SELECT cluster_id, gre_id FROM motifs WHERE gre_id IS NOT NULL) g USING (cluster_id)) GROUP BY ALL""")
def _(m: Star) -> DataFrame:
    """A range of the first chromosome, named by its scaffold, for all GREs."""
    genome = cut(genome_of(m))
    locus = genome.agg(F.min("scaffold")).first()[0]
    return find_scans(genome, m.hits, m.motifs, locus, 100, 900, form="series")


FLAG = "flagged AS (SELECT h.*, EXISTS (SELECT 1 FROM features f WHERE f.contig = h.contig AND ((f.start_pos <= h.start AND f.end_pos >= h.start) OR (f.start_pos <= h.stop AND f.end_pos >= h.stop))) AS in_coding_rgn FROM hits h)"


def flagged_of(m: Star) -> DataFrame:
    return interval.flag_points(m.hits, ["start", "stop"], m.features)


@query("coding_flag", f"{FLAG} SELECT hit_id, in_coding_rgn FROM flagged")
def _(m: Star) -> DataFrame:
    return flagged_of(m).select("hit_id", "in_coding_rgn")


@query("coding_frac", f"{FLAG} SELECT cluster_id, motif_num, round(avg(in_coding_rgn::INT), 4) AS coding_frac FROM flagged GROUP BY ALL")
def _(m: Star) -> DataFrame:
    return interval.coding_fraction(flagged_of(m), ["cluster_id", "motif_num"])


@query("coding_total_frac", "spread AS (SELECT DISTINCT contig, unnest(range(start_pos, end_pos)) AS p FROM features), longest AS (SELECT contig, max(stop) AS n FROM hits GROUP BY 1) SELECT contig, count(*) AS covered, round(count(*) / (max(n) + 1), 6) AS fraction FROM spread JOIN longest USING (contig) GROUP BY 1")
def _(m: Star) -> DataFrame:
    longest = m.hits.groupBy("contig").agg(F.max("stop").alias("n"))
    return interval.covered(m.features).join(longest, "contig").select("contig", "covered", F.round(F.col("covered") / (F.col("n") + 1), 6).alias("fraction"))


# Motifs

PAIRS_SQL = GRAPH_SQL + """,
motif_pairs AS (SELECT src AS query, dst AS target, 1 / pow(1 + counts, 5) AS pvalue, 4 + (src + dst) % 6 AS overlap FROM cooc WHERE src < dst),
good AS (SELECT * FROM motif_pairs WHERE pvalue <= 0.01 AND query <> target AND overlap >= 6),
linked AS (SELECT query AS a, target AS b, round(-log10(pvalue + 1e-99), 4) AS weight FROM good)"""


def pairs_of(m: Star) -> DataFrame:
    once = graph.counted_pairs(m.members)
    return once.select(F.col("src").alias("query"), F.col("dst").alias("target"), (1 / F.pow(1 + F.col("counts"), F.lit(5))).alias("pvalue"), (4 + (F.col("src") + F.col("dst")) % 6).alias("overlap"))


@query("motif_pair_filter", "SELECT query, target, round(pvalue, 9) AS pvalue, overlap FROM good", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    return motif.pair_filter(pairs_of(m)).withColumn("pvalue", F.round("pvalue", 9))


FRACTIONS = "fractions AS (SELECT cluster_id AS motif, avg(raw) AS coding_frac FROM (SELECT row_id AS cluster_id, (row_id % 10) / 10.0 AS raw FROM row_info) GROUP BY 1)"


@query("motif_pair_coding", f"{FRACTIONS} SELECT query, target FROM good LEFT JOIN fractions x ON x.motif = query LEFT JOIN fractions y ON y.motif = target WHERE x.coding_frac < 0.25 OR y.coding_frac < 0.25", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    fractions = m.row_info.select(F.col("row_id").alias("motif"), ((F.col("row_id") % 10) / 10.0).alias("coding_frac"))
    return motif.pair_filter(pairs_of(m), fractions, coding=0.25).select("query", "target")


for _how in ("sum", "max"):

    @query(f"motif_graph_{_how}", f"twice AS (SELECT * FROM linked UNION ALL SELECT b, a, weight / 2 FROM linked) SELECT least(a, b) AS a, greatest(a, b) AS b, round({_how}(weight), 3) AS weight FROM twice GROUP BY 1, 2", PAIRS_SQL)
    def _(m: Star, how: str = _how) -> DataFrame:
        once = motif.pair_weights(motif.pair_filter(pairs_of(m)))
        twice = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("weight") / 2).alias("weight")))
        return graph.combine_parallel(twice, how).withColumn("weight", F.round("weight", 3))


@query("motif_best_repeat", "SELECT query, target, round(min(pvalue), 9) AS pvalue FROM (SELECT query, target, pvalue FROM motif_pairs UNION ALL SELECT query, target, pvalue / 2 FROM motif_pairs) GROUP BY 1, 2", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    once = pairs_of(m)
    # Both at once, so that they stay where the pairs were dealt to.
    twice = once.withColumn("pvalue", F.explode(F.array("pvalue", F.col("pvalue") / 2)))
    return motif.best_of_repeats(twice).select("query", "target", F.round("pvalue", 9).alias("pvalue"))


@query("motif_cluster_stats", "s AS (SELECT gre_id, count(*) AS n FROM motifs GROUP BY 1) SELECT count(*) AS clusters, sum(n)::BIGINT AS motifs, sum((n >= 10)::INT)::BIGINT AS big, round(sum(CASE WHEN n >= 10 THEN n ELSE 0 END) / sum(n), 4) AS share FROM s")
def _(m: Star) -> DataFrame:
    return motif.cluster_stats(m.motifs.groupBy("gre_id").agg(F.count("*").alias("n")))


@query("motif_cluster_genes", "SELECT gre_id, row_id, count(*) AS counts FROM motifs JOIN bc_rows USING (cluster_id) GROUP BY ALL")
def _(m: Star) -> DataFrame:
    return motif.gene_counts(m.motifs, m.bc_rows)


@query("motif_within_clusters", "c AS (SELECT row_id AS motif, group_name AS cluster FROM row_info) SELECT query, target, x.cluster FROM good JOIN c x ON x.motif = query JOIN c y ON y.motif = target AND y.cluster = x.cluster", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    clusters = m.row_info.select(F.col("group_name").alias("cluster"), F.col("row_id").alias("motif"))
    return motif.within_clusters(motif.pair_filter(pairs_of(m)), clusters).select("query", "target", "cluster")


def option_one(m: Star) -> DataFrame:
    """The motif graph with parallel edges summed; each pair stands twice, the second time with half its weight."""
    once = motif.pair_weights(motif.pair_filter(pairs_of(m)))
    twice = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("weight") / 2).alias("weight")))
    return graph.combine_parallel(twice, "sum")


HEAVY = "twice AS (SELECT * FROM linked UNION ALL SELECT b, a, weight / 2 FROM linked), summed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(weight) AS weight FROM twice GROUP BY 1, 2), heavy AS (SELECT * FROM summed WHERE weight > 4)"


@query("motif_heavy_edges", f"{HEAVY} SELECT a, b, round(weight, 3) AS weight FROM heavy", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    return graph.heavier(option_one(m), 4.0).withColumn("weight", F.round("weight", 3))


@query("motif_graph_size", f"{HEAVY} SELECT 'all' AS graph, (SELECT count(*) FROM (SELECT a FROM summed UNION SELECT b FROM summed)) AS vertices, (SELECT count(*) FROM summed) AS edges UNION ALL SELECT 'heavy', (SELECT count(*) FROM (SELECT a FROM heavy UNION SELECT b FROM heavy)), (SELECT count(*) FROM heavy)", PAIRS_SQL)
def _(m: Star) -> DataFrame:
    whole = cut(option_one(m))
    sized = lambda name, edges: graph.size_of(edges).select(F.lit(name).alias("graph"), "vertices", "edges")
    return sized("all", whole).unionByName(sized("heavy", graph.heavier(whole, 4.0)))


EXPORT = "counted AS (SELECT cluster_id, motif_num, count(pvalue) AS num_sites FROM hits GROUP BY ALL), exported AS (SELECT cluster_id, motif_num, evalue, residual, num_sites FROM motifs JOIN biclusters USING (cluster_id) JOIN counted USING (cluster_id, motif_num) WHERE {})"


@query("motif_export", f"{EXPORT.format('residual <= 150000 AND evalue <= 0.05')} SELECT cluster_id, motif_num, evalue, residual, num_sites FROM exported")
def _(m: Star) -> DataFrame:
    return motif.exportable(m.motifs, m.hits, m.biclusters, max_residual=150000, max_evalue=0.05)


@query("motif_export_of_gene", f"{EXPORT.format('cluster_id IN (SELECT cluster_id FROM bc_rows WHERE row_id = (SELECT min(row_id) FROM bc_rows WHERE cluster_id IN (SELECT cluster_id FROM hits)))')} SELECT cluster_id, motif_num, evalue, residual, num_sites FROM exported")
def _(m: Star) -> DataFrame:
    gene = m.bc_rows.join(m.hits.select("cluster_id"), "cluster_id", "left_semi").agg(F.min("row_id")).first()[0]
    return motif.exportable(m.motifs, m.hits, m.biclusters, bridge=m.bc_rows, row_id=gene)


NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY cluster_id, motif_num) AS motif_info_id FROM motifs)"


def cells_of(m: Star) -> DataFrame:
    """The matrices as those of the first motifs of groups."""
    return m.pwm.select(F.col("motif_id").alias("cluster_id"), F.lit(1).alias("motif_num"), "row", "a", "c", "g", "t")


def loaded(m: Star, child: str) -> DataFrame:
    return motif.load_motifs(m.motifs, {"pssm": cells_of(m), "sites": m.hits.select("cluster_id", "motif_num", "hit_id", "contig", "start", "pvalue")})[1][child]


@query("motif_pssm_rows", f"{NUMBERED} SELECT motif_info_id, row, " + ", ".join(f"round({c}, 6) AS {c}" for c in "acgt") + " FROM numbered JOIN pwm ON motif_id = cluster_id AND motif_num = 1")
def _(m: Star) -> DataFrame:
    return loaded(m, "pssm").select("motif_info_id", "row", *(F.round(c, 6).alias(c) for c in "acgt"))


@query("motif_site_rows", f"{NUMBERED} SELECT motif_info_id, hit_id, contig, start, pvalue FROM numbered JOIN hits USING (cluster_id, motif_num)")
def _(m: Star) -> DataFrame:
    return loaded(m, "sites")


@query("motif_best_sites", """placed AS (SELECT gre_id AS cluster, (h.cluster_id % 25)::VARCHAR AS name, pvalue, start FROM hits h JOIN motifs USING (cluster_id, motif_num) WHERE gre_id IS NOT NULL),
sizes AS (SELECT gre_id AS cluster, count(*) AS motifs FROM motifs WHERE gre_id IS NOT NULL AND evalue < 0.01 GROUP BY 1),
best AS (SELECT cluster, name, min(pvalue) AS pvalue, arg_min(start, (pvalue, start)) AS start, count(*) AS n FROM placed GROUP BY ALL),
wide AS (SELECT *, sum((motifs > 100 AND n > motifs / 20.0)::INT) OVER (PARTITION BY cluster) AS remain FROM best JOIN sizes USING (cluster))
SELECT cluster, name, pvalue, start, n FROM wide WHERE (motifs <= 100 AND n > 2) OR (motifs > 100 AND n > motifs / 20.0 AND (remain > 2 OR n > 2))""")
def _(m: Star) -> DataFrame:
    named = interval.gre_hits(m.hits, m.motifs, by_motif=True)
    sites = named.select(F.col("gre_id").alias("cluster"), (F.col("cluster_id") % 25).cast("string").alias("name"), "pvalue", "start")
    sizes = m.motifs.filter("gre_id is not null and evalue < 0.01").groupBy(F.col("gre_id").alias("cluster")).agg(F.count("*").alias("motifs"))
    return motif.best_sites(sites, sizes)


@query("meme_file_rows", f"""{EXPORT.format('evalue <= 0.05')}, named AS (SELECT *, printf('7_%03d_%02d', cluster_id, motif_num) AS name FROM exported)
SELECT cluster_id, motif_num, chr(10) || 'MOTIF ' || name || chr(10) || 'BL   MOTIF ' || name || ' width=0 seqs=0' || chr(10) || 'letter-probability matrix: alength= 4 w= ' || count(*) || ' nsites= ' || any_value(num_sites) || ' E= ' || printf('%.3e', any_value(evalue)) || chr(10)
  || string_agg(printf('%5.3f %5.3f %5.3f %5.3f', a, c, g, t), chr(10) ORDER BY row) AS block
FROM named JOIN pwm ON motif_id = cluster_id AND motif_num = 1 GROUP BY cluster_id, motif_num, name""")
def _(m: Star) -> DataFrame:
    chosen = motif.exportable(m.motifs, m.hits, m.biclusters, max_evalue=0.05)
    return motif.meme_blocks(cells_of(m), ["cluster_id", "motif_num"], chosen, motif.motif_id(F.lit("7"), F.col("cluster_id"), F.col("motif_num")))


@query("evalue_renormalised", "SELECT p_partkey AS row_id, CASE WHEN p_size >= 10 THEN printf('%.1fe+%03d', p_size / 10.0, p_partkey % 9 + 1) ELSE printf('%.1fe+%03d', p_size::DOUBLE, p_partkey % 9) END AS evalue FROM part")
def _(m: Star) -> DataFrame:
    text = F.format_string("%.1fe+%03d", F.col("p_size").cast("double"), F.col("p_partkey") % 9)
    return m.raw("part").select(F.col("p_partkey").alias("row_id"), motif.renormalised(text).alias("evalue"))


MARKOV_ROUNDS = 2
#: Columns of a dozen entries at most, and rounds to a result that SQL can state.
SELECTED = {"least": 0.02, "most": 12, "recover": 6, "share": 0.9}
SELECTED_ROUNDS = 5


def markov_selected_sql() -> str:
    """SELECTED_ROUNDS rounds with selection and recovery, then the components of what is left."""
    least, most, recover, share = SELECTED.values()
    parts = ["""both_ends AS (SELECT a, b, weight FROM linked UNION ALL SELECT b, a, weight FROM linked),
looped AS (SELECT a, b, weight FROM both_ends WHERE a <> b UNION ALL SELECT a, a, max(weight) FROM both_ends GROUP BY a),
start0 AS (SELECT a AS row, b AS col, max(weight) AS p FROM looped GROUP BY ALL), m0 AS MATERIALIZED (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM start0)"""]
    for k in range(SELECTED_ROUNDS):
        parts.append(f"""s{k} AS (SELECT x.row, y.col, pow(sum(x.p * y.p), 2.4) AS p FROM m{k} x JOIN m{k} y ON x.col = y.row GROUP BY ALL), i{k} AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM s{k}),
k{k} AS (SELECT row, col, p, row_number() OVER (PARTITION BY col ORDER BY round(p, 9) DESC, row) AS place, count(*) FILTER (p >= {least}) OVER (PARTITION BY col) AS fit, sum(CASE WHEN p >= {least} THEN p ELSE 0 END) OVER (PARTITION BY col) AS mass, sum(p) OVER (PARTITION BY col) AS whole FROM i{k} WHERE round(p, 9) > 0),
m{k + 1} AS MATERIALIZED (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM k{k} WHERE place <= CASE WHEN fit < {recover} AND mass < {share} * whole THEN {recover} ELSE least(fit, {most}) END)""")
    return ", ".join(parts) + f""", ends AS (SELECT row AS x, col AS y FROM m{SELECTED_ROUNDS} WHERE p > 0.01 UNION SELECT col, row FROM m{SELECTED_ROUNDS} WHERE p > 0.01),
RECURSIVE reach AS (SELECT x AS node, x AS other FROM ends UNION SELECT reach.node, ends.y FROM reach JOIN ends ON reach.other = ends.x) SELECT node, min(other) AS cluster FROM reach GROUP BY 1"""


@query("motif_markov_selected", markov_selected_sql(), PAIRS_SQL)
def _(m: Star) -> DataFrame:
    """Clusters after SELECTED_ROUNDS rounds in which a column keeps its strongest entries."""
    return motif.markov_clusters(motif.pair_weights(motif.pair_filter(pairs_of(m))), rounds=SELECTED_ROUNDS, **SELECTED)


def markov_sql() -> str:
    """The fixed rounds of markov_round, one after another."""
    parts = ["""both_ends AS (SELECT a, b, weight FROM linked UNION ALL SELECT b, a, weight FROM linked),
looped AS (SELECT a, b, weight FROM both_ends WHERE a <> b UNION ALL SELECT a, a, max(weight) FROM both_ends GROUP BY a),
start0 AS (SELECT a AS row, b AS col, max(weight) AS p FROM looped GROUP BY ALL), m0 AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM start0)"""]
    for k in range(MARKOV_ROUNDS):
        parts.append(f"""s{k} AS (SELECT x.row, y.col, pow(sum(x.p * y.p), 2.4) AS p FROM m{k} x JOIN m{k} y ON x.col = y.row GROUP BY ALL), i{k} AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM s{k}),
m{k + 1} AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM i{k} WHERE p >= 1e-4)""")
    return ", ".join(parts) + f" SELECT row, col, round(p, 5) AS p FROM m{MARKOV_ROUNDS} WHERE p >= 0.001"


@query("motif_markov_rounds", markov_sql(), PAIRS_SQL)
def _(m: Star) -> DataFrame:
    now = cut(motif.markov_start(motif.pair_weights(motif.pair_filter(pairs_of(m)))))
    for _ in range(MARKOV_ROUNDS):
        now = cut(motif.markov_round(now))
    return now.filter("p >= 0.001").withColumn("p", F.round("p", 5))


@query("motif_markov", None)
def _(m: Star) -> DataFrame:
    return motif.markov_clusters(motif.pair_weights(motif.pair_filter(pairs_of(m))))


def matrix_sql(letters: str, by: str) -> str:
    inside = " || ',' || ".join(f"printf('%.4f', {c})" for c in letters)
    return f"SELECT {by}, string_agg({inside}, ';' ORDER BY row) AS matrix FROM pwm GROUP BY {by}"


def matrix_text(done: DataFrame, letters: str) -> DataFrame:
    cells = F.transform("matrix", lambda p: F.concat_ws(",", *(F.format_string("%.4f", p[c]) for c in letters)))
    return done.withColumn("matrix", F.array_join(cells, ";"))


@query("pwm_shape", matrix_sql("acgt", "motif_id"))
def _(m: Star) -> DataFrame:
    return matrix_text(motif.matrices(m.pwm, ["motif_id"]), "acgt")


@query("pwm_by_gre", matrix_sql("agct", "gre_id, motif_id"))
def _(m: Star) -> DataFrame:
    return matrix_text(motif.matrices(m.pwm, ["gre_id", "motif_id"], "agct"), "agct")


@query("meme_export_rows", "SELECT motif_id, 'letter-probability matrix: alength= 4 w= ' || count(*) || ' nsites= 0' || chr(10) || string_agg(printf('%5.3f %5.3f %5.3f %5.3f', a, c, g, t), chr(10) ORDER BY row) AS block FROM pwm GROUP BY 1")
def _(m: Star) -> DataFrame:
    return motif.meme_blocks(m.pwm, ["motif_id"])


@query("motif_names", "SELECT cluster_id, motif_num, printf('%s_%03d_%02d', '7', cluster_id, motif_num) AS motif_id, '7' AS run FROM motifs")
def _(m: Star) -> DataFrame:
    named = m.motifs.select("cluster_id", "motif_num", motif.motif_id(F.lit("7"), F.col("cluster_id"), F.col("motif_num")).alias("motif_id"))
    return named.withColumn("run", motif.parse_motif_id(F.col("motif_id"))["run"])


@query("motif_numbered_clusters", "l AS (SELECT l_orderkey AS pos, string_agg(l_partkey::VARCHAR, chr(9) ORDER BY l_partkey, l_suppkey, l_linenumber) AS line, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY pos) AS gre_id FROM l WHERE n >= 4) SELECT gre_id, unnest(string_split(line, chr(9))) AS motif FROM k")
def _(m: Star) -> DataFrame:
    lines = m.raw("lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), "\t").alias("line"))
    return motif.numbered_clusters(lines)


# Runs


@query("last_iteration_members", "i AS (SELECT max(l_linenumber) AS top FROM lineitem) SELECT DISTINCT l_orderkey AS cluster_id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = (SELECT top FROM i)")
def _(m: Star) -> DataFrame:
    last = last_iteration(m.raw("lineitem").select("l_orderkey", F.col("l_linenumber").alias("iteration"), "l_partkey"))
    parts = m.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return last.join(parts, "l_partkey").select(F.col("l_orderkey").alias("cluster_id"), "name").distinct()


@query("multi_run_union", "SELECT run_id, count(*) AS clusters, round(avg(residual), 4) AS residual FROM biclusters GROUP BY 1")
def _(m: Star) -> DataFrame:
    return m.biclusters.groupBy("run_id").agg(F.count("*").alias("clusters"), F.round(F.avg("residual"), 4).alias("residual"))


@query("last_iteration_by_run", "r AS (SELECT l_orderkey % 20 AS run_id, l_linenumber AS iteration, l_partkey FROM lineitem) SELECT run_id, iteration, count(*) AS members FROM r WHERE iteration = (SELECT max(iteration) FROM r x WHERE x.run_id = r.run_id) GROUP BY ALL")
def _(m: Star) -> DataFrame:
    lines = m.raw("lineitem").select((F.col("l_orderkey") % 20).alias("run_id"), F.col("l_linenumber").alias("iteration"), "l_partkey")
    return last_iteration(lines, ["run_id"]).groupBy("run_id", "iteration").agg(F.count("*").alias("members"))


@query("scan_cluster_ids", "SELECT cluster_id, h.hit_id FROM (SELECT hit_id, cluster_id AS cluster, 'run' || cluster_id % 20 AS dirname FROM hits) h JOIN (SELECT cluster_id, cluster_num, 'run' || run_id AS dirname FROM biclusters WHERE run_id < 15) b ON b.dirname = h.dirname AND cluster_num = cluster")
def _(m: Star) -> DataFrame:
    scans = m.hits.select("hit_id", F.col("cluster_id").alias("cluster"), F.concat(F.lit("run"), (F.col("cluster_id") % 20).cast("string")).alias("dirname"))
    runs = m.runs.filter("run_id < 15").select("run_id", F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("dirname"))
    return with_cluster_ids(scans, m.biclusters, runs).select("cluster_id", "hit_id")


@query("run_sizes", "SELECT run_id, count(DISTINCT row_id) AS num_rows, count(DISTINCT col_id) AS num_cols FROM biclusters JOIN bc_rows USING (cluster_id) JOIN bc_cols USING (cluster_id) GROUP BY 1")
def _(m: Star) -> DataFrame:
    runs = m.biclusters.select("cluster_id", "run_id")
    rows = runs.join(m.bc_rows, "cluster_id").groupBy("run_id").agg(F.count_distinct("row_id").alias("num_rows"))
    return rows.join(runs.join(m.bc_cols, "cluster_id").groupBy("run_id").agg(F.count_distinct("col_id").alias("num_cols")), "run_id")


# Resampling

DRAWS, SIZE, KEEP = 20, 5, 0.25


def nulls_sql(name: str, seed: int) -> str:
    u, tried = uniform_sql(seed, "col_id", "row_id", "draw"), resample.tries(SIZE)
    number = f"floor(('0x' || substr(md5('{seed}|' || col_id || '|' || draw || '|' || j // 4), 8 * (j % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT"
    return f"""{name}_cells AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY col_id) AS n FROM expr),
{name}_few AS (SELECT col_id, raw, draw, row_number() OVER (PARTITION BY col_id, draw ORDER BY {u}, row_id) AS place FROM {name}_cells, range({DRAWS}) t(draw) WHERE n < {2 * SIZE}),
{name}_tries AS (SELECT col_id, draw, j, {number} AS pos FROM (SELECT DISTINCT col_id, n FROM {name}_cells WHERE n >= {2 * SIZE}), range({DRAWS}) t(draw), range({tried}) x(j)),
{name}_first AS (SELECT col_id, draw, pos, min(j) AS j FROM {name}_tries GROUP BY ALL),
{name}_picks AS (SELECT *, row_number() OVER (PARTITION BY col_id, draw ORDER BY j) AS place FROM {name}_first),
{name}_drawn AS (SELECT col_id, draw, raw FROM {name}_few WHERE place <= {SIZE} UNION ALL SELECT col_id, draw, raw FROM {name}_picks JOIN {name}_cells USING (col_id, pos) WHERE place <= {SIZE}),
{name}_rsd AS (SELECT col_id, draw, abs(stddev_pop(raw) / nullif(avg(raw), 0)) AS rsd FROM {name}_drawn GROUP BY ALL),
{name} AS (SELECT col_id, {DRAWS} AS resamples, list(rsd ORDER BY rsd) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY rsd, draw) AS place FROM {name}_rsd WHERE rsd IS NOT NULL) WHERE place <= {round(DRAWS * KEEP)} GROUP BY 1)"""


def nulls_of(m: Star, seed: int) -> DataFrame:
    return resample.lowest_rsd(m.expr, SIZE, DRAWS, KEEP, seed)


def listed(done: DataFrame) -> DataFrame:
    return done.select("col_id", "resamples", F.array_join(F.transform("lowest", lambda x: F.format_string("%.6f", x)), ",").alias("lowest"))


TEXT = "array_to_string(list_transform(lowest, lambda x: printf('%.6f', x)), ',') AS lowest"


@query("resample_topk", f"{nulls_sql('one', 1)} SELECT col_id, resamples, {TEXT} FROM one")
def _(m: Star) -> DataFrame:
    return listed(nulls_of(m, 1))


@query("resample_merge_update", f"{nulls_sql('one', 1)}, {nulls_sql('two', 2)}, b AS (SELECT col_id, one.resamples + two.resamples AS resamples, list_sort(list_concat(one.lowest, two.lowest))[1:round((one.resamples + two.resamples) * {KEEP})::INT] AS lowest FROM one JOIN two USING (col_id)) SELECT col_id, resamples, {TEXT} FROM b")
def _(m: Star) -> DataFrame:
    return listed(resample.merge(nulls_of(m, 1), nulls_of(m, 2), KEEP))


@query("resample_top_up", f"{nulls_sql('one', 1)} SELECT col_id, resamples, {TEXT} FROM one")
def _(m: Star) -> DataFrame:
    """Two fifths of the draws, stored for half of the columns; then what lacks for all of them to have all draws."""
    table = Versioned(m.spark, fresh_path(m.spark, "nulls"), lambda: F.col("nrows"))
    columns = m.expr.select("col_id").distinct().withColumn("nrows", F.lit(SIZE))
    resample.store_nulls(table, m.expr, columns.filter("col_id % 2 = 0"), DRAWS * 2 // 5, KEEP)
    return listed(resample.store_nulls(table, m.expr, columns, DRAWS, KEEP))


def corem_nulls_sql(least_p: float) -> str:
    """Each corem's columns against nulls of its size; nulls_sql for all sizes of corems at once."""
    u = uniform_sql(1, "col_id", "row_id", "draw")
    number = "floor(('0x' || substr(md5('1|' || col_id || '|' || draw || '|' || j // 4), 8 * (j % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT"
    return f"""csize AS (SELECT corem_id, count(*) AS size FROM corem_rows GROUP BY 1), sizes AS (SELECT DISTINCT size FROM csize),
cells AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY col_id) AS n FROM expr),
few AS (SELECT size, col_id, raw, draw, row_number() OVER (PARTITION BY size, col_id, draw ORDER BY {u}, row_id) AS place FROM cells, range({DRAWS}) t(draw), sizes WHERE n < 2 * size),
tries AS (SELECT col_id, draw, j, {number} AS pos FROM (SELECT DISTINCT col_id, n FROM cells), range({DRAWS}) t(draw), (SELECT unnest(range(3 * max(size) + 20)) AS j FROM sizes)),
firsts AS (SELECT col_id, draw, pos, min(j) AS j FROM tries GROUP BY ALL), picks AS (SELECT *, row_number() OVER (PARTITION BY col_id, draw ORDER BY j) AS place FROM firsts),
drawn AS (SELECT size, col_id, draw, raw FROM few WHERE place <= size UNION ALL SELECT size, col_id, draw, raw FROM picks JOIN cells USING (col_id, pos) JOIN sizes ON place <= size AND n >= 2 * size),
rsds AS (SELECT size, col_id, draw, round(abs(stddev_pop(raw) / nullif(avg(raw), 0)), 12) AS rsd FROM drawn GROUP BY ALL),
lows AS (SELECT size, col_id, list(rsd ORDER BY rsd) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY size, col_id ORDER BY rsd, draw) AS place FROM rsds WHERE rsd IS NOT NULL) WHERE place <= {round(DRAWS * KEEP)} GROUP BY ALL),
seen AS (SELECT corem_id, col_id, abs(stddev_pop(raw) / nullif(avg(raw), 0)) AS rsd FROM corem_rows JOIN expr USING (row_id) GROUP BY ALL),
t AS (SELECT corem_id, col_id, {DRAWS} AS resamples, len(lowest) AS kept, len(list_filter(lowest, lambda y: y <= rsd)) AS below FROM seen JOIN csize USING (corem_id) JOIN lows USING (size, col_id) WHERE rsd IS NOT NULL),
p AS (SELECT corem_id, col_id, CASE WHEN below / resamples >= kept / resamples THEN round(kept / resamples, 2) WHEN below = 0 THEN 1 / resamples ELSE below / resamples END AS pval FROM t)
SELECT corem_id, col_id, round(pval, 6) AS pval FROM p WHERE pval <= {least_p}"""


@query("corem_columns_at_cut", f"{LINKED_SQL.strip()}, {corem_nulls_sql(0.2)}", GRAPH_SQL)
def _(m: Star) -> DataFrame:
    """corem_columns of the SQL's cut, with the draws that the SQL states."""
    held = cut(communities.corem_rows(corems_of(m, THRESHOLDS)))
    return corem_columns(held, m.expr, DRAWS, KEEP, 0.2).withColumn("pval", F.round("pval", 6))


@query("empirical_pval", f"{nulls_sql('one', 1)}, seen AS (SELECT col_id, abs(stddev_pop(raw) / nullif(avg(raw), 0)) AS rsd FROM expr WHERE row_id IN ({_list(list(range(60)))}) GROUP BY 1), t AS (SELECT col_id, resamples, len(lowest) AS kept, len(list_filter(lowest, lambda y: y <= rsd)) AS below FROM seen JOIN one USING (col_id) WHERE rsd IS NOT NULL) SELECT col_id, round(CASE WHEN below / resamples >= kept / resamples THEN round(kept / resamples, 2) WHEN below = 0 THEN 1 / resamples ELSE below / resamples END, 6) AS pval FROM t")
def _(m: Star) -> DataFrame:
    seen = expression.rsd_by_column(m.expr, list(range(60)))
    return resample.empirical_pvalue(seen, nulls_of(m, 1), cutoff=None).withColumn("pval", F.round("pval", 6))


# Blocks

RUN_BLOCKS = "run_blocks AS (SELECT DISTINCT run_id, block FROM biclusters JOIN bc_cols USING (cluster_id) JOIN blocks USING (col_id) WHERE residual > 400000), groups AS (SELECT group_id, string_agg(DISTINCT block, ':::' ORDER BY block) AS grp FROM blocks GROUP BY 1)"


def run_blocks_of(m: Star) -> DataFrame:
    return m.biclusters.filter("residual > 400000").join(m.bc_cols, "cluster_id").join(m.blocks, "col_id").select("run_id", "block").distinct()


def groups_of(m: Star) -> DataFrame:
    return m.blocks.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_set("block")), ":::").alias("group")).select("group")


@query("block_freq", f"{RUN_BLOCKS} SELECT block, round(count(*) / 20, 6) AS freq FROM run_blocks GROUP BY 1")
def _(m: Star) -> DataFrame:
    return blocks.block_frequency(run_blocks_of(m), 20).withColumn("freq", F.round("freq", 6))


@query("block_coinclusion", f"""{RUN_BLOCKS}, member AS (SELECT grp, unnest(string_split(grp, ':::')) AS block FROM groups), sizes AS (SELECT grp, count(*) AS size FROM member GROUP BY 1),
held AS (SELECT grp, run_id, count(*) AS n FROM member JOIN run_blocks USING (block) GROUP BY ALL), per AS (SELECT grp, count(*) AS runs_any, sum(n) AS held, sum((n = size)::INT) AS whole FROM held JOIN sizes USING (grp) GROUP BY 1)
SELECT grp AS "group", round(coalesce(runs_any / 20, 0), 2) AS freq_single, round(coalesce(held / nullif(size * runs_any, 0), 0), 2) AS freq_coinclusion, round(coalesce(whole / 20, 0), 2) AS max_coinclusion_all, round(coalesce(whole / nullif(runs_any, 0), 0), 2) AS max_coinclusion_sub FROM sizes LEFT JOIN per USING (grp)""")
def _(m: Star) -> DataFrame:
    return blocks.coinclusion(groups_of(m), run_blocks_of(m), 20)


@query("block_pairs", f"{RUN_BLOCKS}, member AS (SELECT grp, unnest(string_split(grp, ':::')) AS block FROM groups) SELECT DISTINCT p.block AS x, q.block AS y FROM member p JOIN member q USING (grp) WHERE p.block <> q.block")
def _(m: Star) -> DataFrame:
    return blocks.block_pairs(groups_of(m))


@query("block_weights", "member AS (SELECT group_id, block FROM blocks) SELECT DISTINCT p.block AS x, q.block AS y, 2.0::DOUBLE AS weight FROM member p JOIN member q USING (group_id) WHERE p.block <> q.block")
def _(m: Star) -> DataFrame:
    return blocks.inclusion_weights(groups_of(m))


@query("column_picks", None)
def _(m: Star) -> DataFrame:
    """Columns of 20 runs; as many blocks as there are nations come to the driver."""
    listed = {r["block"]: r["cols"] for r in m.blocks.groupBy("block").agg(F.array_sort(F.collect_set("sample")).alias("cols")).orderBy("block").collect()}
    together = {(r["x"], r["y"]): r["weight"] for r in blocks.inclusion_weights(groups_of(m)).collect()}
    sizes = {b: len(c) for b, c in listed.items()}
    picked = blocks.pick_columns(listed, blocks.random_exclusions(sizes, 4, sum(sizes.values())), 20, sum(sizes.values()) / 8, 1.0, together=together)
    return m.spark.createDataFrame([(k, len(r["blocks"]), len(r["cols"]), r["excluded"]) for k, r in enumerate(picked)], "run int, blocks int, cols int, excluded string")


@query("weighted_sample", f"SELECT col_id FROM (SELECT col_id, pow({uniform_sql(5, 'col_id')}, 1.0 / (1 + col_id % 7)) AS k FROM col_info) ORDER BY k DESC, col_id LIMIT 20")
def _(m: Star) -> DataFrame:
    return blocks.weighted_sample(m.col_info.select("col_id"), "col_id", (1 + F.col("col_id") % 7).cast("double"), 20, 5).select("col_id")


@query("sample_without_replacement", f"SELECT run_id, cluster_id FROM (SELECT run_id, cluster_id, row_number() OVER (PARTITION BY run_id ORDER BY {uniform_sql(3, 'cluster_id')}, cluster_id) AS k FROM biclusters) WHERE k <= 10")
def _(m: Star) -> DataFrame:
    line = Window.partitionBy("run_id").orderBy(uniform(3, F.col("cluster_id")), "cluster_id")
    return m.biclusters.withColumn("k", F.row_number().over(line)).filter("k <= 10").select("run_id", "cluster_id")


@query("split_bins", "n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, count(*) OVER () AS n FROM supplier) SELECT pos, (SELECT max(i) FROM range(7) t(i) WHERE i * n // 7 <= pos) AS bin FROM n")
def _(m: Star) -> DataFrame:
    line = in_order(m.raw("supplier").select("s_suppkey"), ["s_suppkey"], "pos")
    n = line.agg(F.count("*").alias("n"))  # one row
    return line.crossJoin(F.broadcast(n)).select("pos", blocks.bin_of(F.col("pos"), F.col("n"), 7).alias("bin"))
