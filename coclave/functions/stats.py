"""Column builders for the statistics; all of them stay in Spark's own expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.operators.number import least_from_here
from coclave.runtime import cut

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_SMALL = 16


def log_factorial(x: Column) -> Column:
    """log(x!) for whole x >= 0: a table up to 15, Stirling's series beyond, good to about 1e-13."""
    y = x.cast("double") + 1
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(_SMALL)))
    return F.when(x < _SMALL, F.get(table, F.greatest(x, F.lit(0)).cast("int"))).otherwise((y - 0.5) * F.log(y) - y + _HALF_LOG_2PI + series)


def _upper_tail(p: Column) -> Column:
    """P(X > k) of p = struct(m, n, d, k), or 1 less it where p.flip; terms fall from the first on.

    Lambdas keep each long expression in one place: a plain expression would be repeated, and compiled, for every use.
    """
    m, n, d = p["m"], p["n"], p["d"]
    first, high = F.greatest(p["k"] + 1, F.lit(0.0), n + d - m), F.least(n, d)
    signed = [(1, n), (-1, first), (-1, n - first), (1, m - n), (-1, d - first), (-1, m - n - d + first), (-1, m), (1, d), (1, m - d)]
    parts = F.array(*(F.struct(F.lit(float(sign)).alias("sign"), x.alias("x")) for sign, x in signed))
    log_first = F.aggregate(parts, F.lit(0.0), lambda acc, t: acc + t["sign"] * log_factorial(t["x"]))
    ratio = lambda i: (n - i) * (d - i) / ((i + 1) * (m - n - d + i + 1))
    fall = ratio(first)
    terms = F.when((fall > 0) & (fall < 1), F.least(high - first, F.ceil(-42 / F.log(fall)))).otherwise(F.lit(0.0))
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(terms, F.lit(0.0)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct((acc["term"] * ratio(first + j)).alias("term"), (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"],
    )
    tail = F.when(first > high, 0.0).otherwise(F.least(F.exp(log_first) * total, F.lit(1.0)))
    return F.when(p["flip"], 1 - tail).otherwise(tail)


def hypergeom_sf(hits: Column, population: Column, marked: Column, drawn: Column, inclusive: bool = False) -> Column:
    """P(X > hits), X hypergeometric; P(X >= hits) if inclusive.

    The tail away from the mode is summed by its term ratio until terms no longer count, in proportion to its first term, so
    neither tables over the population nor more terms than matter are needed. Left of the mode the tail is that of the unmarked
    among the drawn. 0 where hits reach min(marked, drawn).
    """
    k = hits.cast("double") - (1 if inclusive else 0)
    m, n, d = population.cast("double"), marked.cast("double"), drawn.cast("double")
    at = F.greatest(k + 1, F.lit(0.0), n + d - m)
    flip = (n - at) * (d - at) >= (at + 1) * (m - n - d + at + 1)
    one = F.struct(m.alias("m"), F.when(flip, m - n).otherwise(n).alias("n"), d.alias("d"), F.when(flip, d - k - 1).otherwise(k).alias("k"), flip.alias("flip"))
    tail = F.get(F.transform(F.array(one), _upper_tail), F.lit(0))
    return F.when(k >= F.least(n, d), 0.0).when(k < F.greatest(F.lit(0.0), n + d - m), 1.0).otherwise(tail)


def neg_log10(p: Column, digits: int = 4, floor: float = 1e-300) -> Column:
    return F.round(-F.log10(F.greatest(p, F.lit(floor))), digits) + 0.0


def adjusted(df: DataFrame, p: str = "pval", order: str = "key") -> DataFrame:
    """Adds qval_bh and qval_bonferroni over all rows; ties in p share their value whatever the order.

    Tests are ranked by ranges of p, and the least of the later ranges goes from range to range, so no task sees them all.
    """
    both = least_from_here(df, [p, order], lambda rank, n: F.col(p) * n / rank, "qval_bh", "__n")
    return both.withColumn("qval_bh", F.least(F.lit(1.0), F.col("qval_bh"))).withColumn("qval_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")


def adjusted_within(df: DataFrame, by: list[str], p: str = "pval", order: str = "key") -> DataFrame:
    """adjusted() of each group of rows by itself; a group is the tests of one question."""
    whole = Window.partitionBy(*by)
    ranked = df.withColumn("__n", F.count("*").over(whole)).withColumn("__rank", F.row_number().over(whole.orderBy(p, order)))
    back = whole.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("qval_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(back)))
        .withColumn("qval_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("__n")))
        .drop("__n", "__rank")
    )


def percentiles(df: DataFrame, value: str, shares: list[float], bins: int = 1024, few: int = 10_000) -> list[float | None]:
    """Exact percentiles with linear interpolation; nulls and NaN do not count, and without values all are null.

    The ranks that they need are sought by histograms: a pass counts the values of `bins` equal parts of each range that is still
    open, and the part that holds a rank is the next range, until it has one value or at most `few`, which are looked through.
    What comes to the driver is bounded by bins, few and the number of shares.
    """
    rows = cut(df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * share for share in shares]
    found: dict[int, float] = {}
    open_ = {(low, high, 0, n): {r for h in places for r in (math.floor(h), math.ceil(h))}}
    while open_:
        ranges, parts = list(open_), None
        for k, (a, b, _, count) in enumerate(ranges):
            inside = rows.filter((F.col("v") >= a) & (F.col("v") <= b))
            v = F.col("v")
            if a == b or count <= few:
                place = F.lit(0)
            elif math.isinf(a) or math.isinf(b):
                place = F.when(v == -math.inf, 0).when(v == math.inf, 2).otherwise(1)
            else:
                place = F.least(F.floor((v / 2 - a / 2) / (b / 2 - a / 2) * bins), F.lit(bins - 1)).cast("int")
            own = inside.groupBy(F.lit(k).alias("k"), place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            parts = own if parts is None else parts.unionByName(own)
        counted = sorted(tuple(r) for r in parts.collect())
        next_: dict[tuple[float, float, int, int], set[int]] = {}
        for k, (a, b, before, count) in enumerate(ranges):
            if a == b:
                found.update(dict.fromkeys(open_[a, b, before, count], a))
            elif count <= few:
                line = sorted(r["v"] for r in rows.filter((F.col("v") >= a) & (F.col("v") <= b)).collect())
                found.update({r: line[r - before] for r in open_[a, b, before, count]})
            else:
                upto = before
                for _, _, m, x, y in (c for c in counted if c[0] == k):
                    if here := {r for r in open_[a, b, before, count] if upto <= r < upto + m}:
                        next_[x, y, upto, m] = here
                    upto += m
        open_ = next_
    return [found[math.floor(h)] + (found[math.ceil(h)] - found[math.floor(h)]) * (h - math.floor(h)) if math.floor(h) != math.ceil(h) else found[int(h)] for h in places]


def rsd(x: Column) -> Column:
    """Relative standard deviation, of the population; an aggregate."""
    return F.abs(F.try_divide(F.stddev_pop(x), F.avg(x)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts, not on partitions; other engines can compute it too."""
    said = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("double") / float(1 << 48)


def uniform_sql(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(f'{p}::VARCHAR' for p in parts)}), 1, 12))::BIGINT / {float(1 << 48)}::DOUBLE)"


def now_millis() -> Column:
    """Milliseconds since 1970, the same for all rows of a query."""
    return F.unix_millis(F.current_timestamp())


def list_text(values: Column) -> Column:
    """An array as JSON text."""
    return F.to_json(values)


def text_list(text: Column, kind: str = "double") -> Column:
    """JSON text as an array; null where it is none."""
    return F.from_json(text, f"array<{kind}>")
