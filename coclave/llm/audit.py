"""How the sources of a language differ in their terms, from joint count histograms.

A pair of sources is compared by a tally of (count here, count there) over the kept terms of the language: how many terms have each
combination. Combinations of two counts above 0 come from joining the sources' counts on the term; those with a 0 on either side,
and with two, are what a source's own histogram has left. The difference is evaluated once per combination, times its multiplicity.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coclave.runtime import keep, mapped, ready, small

#: Bytes of terms, A-Z in lower case; all others part them.
TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Terms that a task holds before it writes them out.
HELD = 1 << 18


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs): occurrences and documents, sums of parts of the rows; columns lang, source, text."""
    found: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in found.items():
            if terms:
                count, docs = zip(*terms.values(), strict=True)
                columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = found[lang, source]
            held -= len(terms)
            for term, n in Counter(text.as_buffer().to_pybytes().translate(TERM).split()).items():
                if term in terms:
                    terms[term][0] += n
                    terms[term][1] += 1
                else:
                    terms[term] = [n, 1]
            held += len(terms)
            if held >= HELD:
                yield from out()
                found.clear()
                held = 0
    if held:
        yield from out()


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact."""
    wide = "decimal(20,0)"
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast(wide)
    return F.lit(1) + F.call_function("div", above, (total + 5 * terms).cast(wide))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets every source of a language apart from the others and from the language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case; a language keeps those in `least` of its documents
    or more. Part `pair` has a row for each other source: the sum of abs(p - q) over all kept terms; part `term` the `most` terms that
    the source has and prefers to its language, by p - q. p and q are smoothed shares in parts of 10^9.

    Null texts, languages and sources are empty ones; a row is a document, repeated or not. A source without kept terms has its
    pairs too; one that is alone in its language has none. Other columns are ignored; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    counted = mapped(rows, _counts, "lang string, source string, term string, count long, docs long")
    # All counts of a term of a language go to one task, which adds up the sources' and the language's: one shuffle for both.
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"everywhere": F.sum("count").over(everywhere), "docs": F.sum("docs").over(everywhere)})
    cells = keep(summed.filter(F.col("docs") >= least).drop("docs"), "cells")
    # A row for each language and for each group, whether it has terms or not.
    langs = cells.select("lang", "term", "everywhere").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("everywhere").alias("of_lang"))
    groups = rows.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "of_lang")))
    groups = small(groups, "groups")
    one, two = (groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), *(["terms"] if x == "a" else [])) for x in "ab")
    both = one.join(two, "lang").filter("a < b")
    # The tally: combinations that occur, then own histograms less what the former have used.
    here, there = (cells.select("lang", "term", F.col("source").alias(x), F.col("count").alias(f"count_{x}")) for x in "ab")
    key = ["lang", "a", "b"]
    joint = keep(here.join(there, ["lang", "term"]).filter("a < b").groupBy(*key, "count_a", "count_b").agg(F.count("*").alias("many")), "joint")
    zero, names = F.lit(0).cast("long"), (*key, "count_a", "count_b", "many")
    own = small(cells.groupBy("lang", "source", "count").agg(F.count("*").alias("many")), "histograms")
    alone_a = both.join(own.withColumnsRenamed({"source": "a", "count": "count_a"}), ["lang", "a"]).withColumn("count_b", zero)
    alone_b = both.join(own.withColumnsRenamed({"source": "b", "count": "count_b"}), ["lang", "b"]).withColumn("count_a", zero)
    less = F.col("many") * -1
    tally = (
        joint.unionByName(joint.withColumn("count_b", zero).withColumn("many", less))
        .unionByName(joint.withColumn("count_a", zero).withColumn("many", less))
        .unionByName(alone_a.select(*names))
        .unionByName(alone_b.select(*names))
        # Terms that neither has: all, without those of either, and those of both were taken twice.
        .unionByName(both.withColumnsRenamed({"terms": "many"}).select(*key, zero.alias("count_a"), zero.alias("count_b"), "many"))
        .unionByName(joint.withColumn("count_a", zero).withColumn("count_b", zero))
        .unionByName(alone_a.withColumn("count_a", zero).withColumn("many", less).select(*names))
        .unionByName(alone_b.withColumn("count_b", zero).withColumn("many", less).select(*names))
        .groupBy(*key, "count_a", "count_b")
        .agg(F.sum("many").alias("many"))
        .filter("many <> 0")
    )
    p = probability(F.col("count_a"), F.col("total_a"), F.col("terms"))
    q = probability(F.col("count_b"), F.col("total_b"), F.col("terms"))
    apart = tally.join(both, key).groupBy(*key).agg(F.sum(F.abs(p - q) * F.col("many")).alias("value"))
    apart = both.select(*key).join(apart, key, "left").withColumn("value", F.coalesce("value", zero))
    sides = apart.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(apart.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    pairs = sides.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    value = probability(F.col("count"), F.col("total"), F.col("terms")) - probability(F.col("everywhere"), F.col("of_lang"), F.col("terms"))
    terms = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
