"""Mixing sources to target weights, with DataFrame expressions only.

Weights belong to the nodes of a tree, domain over language over source. A token budget flows from the root down; a child gets its
share by weight, but no more than the tokens under it times the allowed epochs, and what it cannot use goes to its siblings in
proportion to their weights. As each node's budget already fits what lies under it, a shortage reaches a node's siblings only
when its own children are all exhausted. A leaf with budget b over t tokens repeats whole epochs and then takes a prefix of a
seeded order of its documents.

Gathered are sums per leaf and over a fixed number of ranges of the seeded order per leaf, and again over as many parts of the one
range of a leaf where its prefix ends. Documents are ranked only inside the one part where it ends, one in four million of a leaf,
from a table of hashes and token counts; the last that is taken is the leaf's cut. Whole rows are read once more and compared with
it, and are never dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.runtime import cut, keep

#: Ranges of the seeded order per leaf, and parts of a range; the order has 2 ** 48 places.
RANGES = 2048
WIDTH, PART = 2**48 // RANGES, 2**48 // RANGES**2
LEVELS = ["domain", "lang", "source"]
#: Leaves that are broadcast; beyond it they are joined by shuffling.
BROADCAST_LEAVES = 20_000


def count_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09 to 0x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(seed: int, *parts: Column) -> Column:
    """48 bits that depend on the seed and the parts only."""
    said = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long")


def _share_out(nodes: DataFrame, parent: list[str], given: Column) -> DataFrame:
    """Water filling among siblings: adds `budget`, the least of capacity and weight times the level that spends the whole.

    Children are lined up by capacity over weight. The level is what is left for the first child that does not fill up, divided
    by the weights from it on; if all fill up, each has its capacity.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = by.orderBy("ratio", "name")
    lined = (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("filled", F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("try", F.when(F.col("open") > 0, (given - F.col("filled")) / F.col("open")))
        .withColumn("level", F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "name", "try"))).over(by)["try"])
    )
    budget = F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("level") * F.col("weight")))
    return lined.withColumn("budget", budget)


def leaf_budgets(leaves: DataFrame, weights: DataFrame, total: float, max_epochs: float = 1.0) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens) and weights (level, name, weight).

    A node that `weights` does not name weighs 1; one that weighs 0 gets nothing and holds no capacity for those above it.
    """
    named = weights.groupBy("level", "name").agg(F.max("weight").cast("double").alias("weight"))

    def weighed(nodes: DataFrame, level: str) -> DataFrame:
        own = named.filter(F.col("level") == level).select(F.col("name").alias(level), "weight")
        joined = nodes.join(own, level, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("name", F.col(level))
        return joined.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))

    sources = weighed(leaves.withColumn("capacity", F.col("tokens") * F.lit(float(max_epochs))), "source")
    langs = weighed(sources.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")), "lang")
    domains = weighed(langs.groupBy("domain").agg(F.sum("capacity").alias("capacity")), "domain")
    domains = _share_out(domains, [], F.lit(float(total))).select("domain", F.col("budget").alias("upper"))
    langs = _share_out(langs.join(domains, "domain"), ["domain"], F.col("upper")).select("domain", "lang", F.col("budget").alias("upper"))
    return _share_out(sources.join(langs, ["domain", "lang"]), ["domain", "lang"], F.col("upper")).select(*LEVELS, "tokens", "budget")


def choose(
    docs: DataFrame,
    weights: DataFrame,
    domain: Column,
    share: float = 0.5,
    max_epochs: float = 1.0,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(row, domain, lang, source, n_tokens, copies) for every chosen row; row is the whole input row as a struct.

    The budget is `share` of all tokens. A row is taken once for each whole epoch of its leaf, and once more if the tokens up to
    and with it in the seeded order of the last epoch fit what is left; the order goes by a hash of key and token count, then
    by these two, and rows equal in them are taken all or none. Null texts have no token and follow the prefix they stand in. Null
    keys, languages and sources count as "". Repeated rows are rows of their own. Clashing columns stay inside `row`. An empty table
    gives no rows.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        name(lang).alias("lang"),
        name(source).alias("source"),
        count_words(F.col(text)).alias("n_tokens"),
        F.col(key).alias("key"),
    ).withColumn("at", seeded_order(seed, F.col("key"), F.col("n_tokens")))
    slim = keep(rows.select(*LEVELS, "n_tokens", "key", "at", F.expr(f"at div {WIDTH}").alias("range")), "mix")
    ranges = cut(slim.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range")))
    leaves = ranges.groupBy(*LEVELS).agg(F.sum("in_range").alias("tokens"))
    total = (ranges.agg(F.sum("in_range")).first()[0] or 0) * share
    budgets = (
        leaf_budgets(leaves, weights, total, max_epochs)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor((F.col("budget") + 1e-6) / F.col("tokens"))).otherwise(0))
        .withColumn("rest", F.floor(F.col("budget") - F.col("epochs") * F.col("tokens") + 1e-6))
        .filter("budget > 0")
        .select(*LEVELS, "epochs", "rest")
    )

    def first_beyond(sums: DataFrame, at: str, before: Column) -> DataFrame:
        """Adds `end`, the first place where the sums of a leaf pass its rest, and `before`, the tokens ahead of it; null if none does."""
        line = Window.partitionBy(*LEVELS).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("upto", before + F.sum("tokens").over(line))
        found = F.min(F.when(F.col("upto") > F.col("rest"), F.struct(at, (F.col("upto") - F.col("tokens")).alias("before")))).alias("end")
        return upto.groupBy(*LEVELS, "epochs", "rest").agg(found).select(*LEVELS, "epochs", "rest", F.col(f"end.{at}").alias("end"), F.col("end.before").alias("before"))

    ends = cut(first_beyond(ranges.withColumnRenamed("in_range", "tokens").join(budgets, LEVELS), "range", F.lit(0)))
    small = ends.count() <= BROADCAST_LEAVES
    given = lambda df: F.broadcast(df) if small else df
    edge = slim.join(given(ends.filter("rest > 0")), LEVELS).filter("range = end").withColumn("part", F.expr(f"at div {PART}"))
    parts = edge.groupBy(*LEVELS, "epochs", "rest", "before", "part").agg(F.sum("n_tokens").alias("tokens"))
    inner = cut(first_beyond(parts, "part", F.col("before")).select(*LEVELS, "rest", F.col("end").alias("part"), F.col("before").alias("ahead")))
    line = Window.partitionBy(*LEVELS).orderBy("at", "key", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = edge.select(*LEVELS, "part", "at", "key", "n_tokens").join(given(inner), [*LEVELS, "part"]).withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(line))
    place = F.struct("at", "key", "n_tokens")
    last = ranked.filter("upto <= rest").groupBy(*LEVELS).agg(F.max(place).alias("last"))
    cuts = cut(ends.join(inner.select(*LEVELS, "part"), LEVELS, "left").join(last, LEVELS, "left").select(*LEVELS, "epochs", "rest", "end", (F.col("part") * PART).alias("limit"), "last"))
    within = F.col("end").isNull() | (F.col("at") < F.col("limit")) | F.coalesce(place <= F.col("last"), F.lit(False))
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & within, 1).otherwise(0)
    return rows.join(given(cuts), LEVELS).withColumn("copies", copies.cast("long")).filter("copies > 0").select("row", *LEVELS, "n_tokens", "copies")
