"""Null distributions by seeded resampling, and empirical p-values against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coclave.functions.stats import uniform
from coclave.operators.number import in_order
from coclave.runtime import cut, dealt
from coclave.sources.versioned import Versioned


def drawn_positions(seed: int, col: Column, draw: Column, n: Column, size: int) -> Column:
    """The first `size` different ones of tries(size) seeded numbers below n: a draw without replacement from n >= 2 * size.

    Four numbers come from one hash. That fewer than `size` of the tries differ is less likely than 1 in 10 ** 9; the draw then holds
    those.
    """
    hashed = F.transform(F.sequence(F.lit(0), F.lit(tries(size) // 4 - 1)), lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string"), draw.cast("string"), b.cast("string"))))
    number = lambda h, k: F.floor(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32) * n).cast("long")
    return F.slice(F.array_distinct(F.flatten(F.transform(hashed, lambda h: F.array(*(number(h, k) for k in range(4)))))), 1, size)


def tries(size: int) -> int:
    return -(-(3 * size + 16) // 4) * 4


#: The draws that a column asks for, in SQL.
DRAWS = "explode(sequence(__first, __first + __count - 1)) AS draw"
#: How many draws of a column are dealt out together.
DRAWS_AT_ONCE = 256


def tried_positions(columns: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(__col, __n, draw, __place, __pos) of the draws that the columns (__col, __start, __n, __first, __count) ask for.

    Up to the largest of the ascending `sizes` that is at most half of a column's rows. The columns may lie in one partition, so
    runs of their draws are dealt out by the number of positions before these are made.
    """
    asked = F.array(*map(F.lit, sizes))
    half = F.coalesce(F.array_max(F.filter(asked, lambda s: s * 2 <= F.col("__n"))), F.lit(0))
    many = columns.withColumn("__half", half).filter("__half > 0")
    made = {r["__half"]: r["draws"] for r in many.groupBy("__half").agg(F.sum("__count").alias("draws")).collect()}
    tried = None
    for size in sorted(made) or sizes[:1]:  # one plan per step of the longest sequence, each over columns of their own
        runs = many.filter(F.col("__half") == size).select("__col", "__n", "__start", (F.col("__first") + F.col("__count")).alias("__end"), F.expr(f"explode(sequence(__first, __first + __count - 1, {DRAWS_AT_ONCE})) AS __first"))
        runs = dealt(runs, made.get(size, 0) * size, "__col", "__first")
        each = runs.withColumn("__count", F.least(F.lit(DRAWS_AT_ONCE), F.col("__end") - F.col("__first"))).select("__col", "__n", "__start", F.expr(DRAWS))
        own = each.select("__col", "__n", "__start", "draw", F.posexplode(drawn_positions(seed, F.col("__col"), F.col("draw"), F.col("__n"), size)).alias("__place", "__pos"))
        tried = own if tried is None else tried.unionByName(own)
    return tried.select("__col", "__n", "draw", (F.col("__place") + 1).alias("__place"), (F.col("__pos") + F.col("__start")).alias("__pos"))


def rsd_of_draws(cells: DataFrame, sizes: list[int], first: Column, count: Column, seed: int = 1, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """(col, nrows, draw, rsd) of the draws first .. first + count - 1 of each size, from one sequence of rows per column and draw.

    A draw of a size is the beginning of the column's sequence of that draw: a sequence is drawn once, as long as the largest size
    asks, and its running moments give the deviation at every size on the way. So a draw of a size is the same whatever other sizes
    are asked for. `first` and `count` may be columns of `cells` that are constant within a column, so that each is drawn as
    far as it needs.

    A column's cells are numbered once, in order of their rows, from ranges; draws are seeded positions, joined to the cells, so
    what is shuffled is the largest size times draws and not cells times draws. Sizes of more than half of a column's rows go by the
    rows of least seeded numbers instead, which are few there; with fewer rows than a size they draw all. RSDs have 12 places,
    as sums depend on order; null where the mean is 0.
    """
    sizes = sorted(set(sizes))
    held = cells.filter(F.col(value).isNotNull()).select(F.col(row).alias("__row"), F.col(col).alias("__col"), F.col(value).alias("__value"), first.cast("long").alias("__first"), count.cast("long").alias("__count"))
    line = in_order(held, ["__col", "__row"], "__pos")
    columns = line.groupBy("__col").agg(F.min("__pos").alias("__start"), F.count("*").alias("__n"), F.min("__first").alias("__first"), F.max("__count").alias("__count")).filter("__count > 0")
    columns = cut(columns)
    line = line.drop("__first", "__count")
    asked = F.array(*map(F.lit, sizes))
    tried = tried_positions(columns, sizes, seed)
    # Spark takes the positions for as few as the runs they come from, and would broadcast them.
    picked = tried.hint("merge").join(line.select("__pos", "__value"), "__pos").select("__col", "__n", "draw", "__place", "__value", F.lit(False).alias("__few"))
    few = line.join(columns.filter(F.col("__n") < 2 * sizes[-1]), "__col").select("*", F.expr(DRAWS))
    rank = Window.partitionBy("__col", "draw").orderBy(uniform(seed, F.col("__col"), F.col("__row"), F.col("draw")), "__row")
    few = few.withColumn("__place", F.row_number().over(rank)).filter(F.col("__place") <= sizes[-1]).select("__col", "__n", "draw", "__place", "__value", F.lit(True).alias("__few"))
    along = Window.partitionBy("__col", "draw", "__few").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    moved = few.unionByName(picked).withColumn("rsd", F.round(F.abs(F.try_divide(F.stddev_pop("__value").over(along), F.avg("__value").over(along))), 12))
    own = F.filter(asked, lambda s: (F.least(s, F.col("__n")) == F.col("__place")) & ((s * 2 > F.col("__n")) == F.col("__few")))
    ends = moved.filter(F.col("__place").isin(sizes) | (F.col("__place") == F.col("__n")))
    return ends.select(F.col("__col").alias(col), F.explode(own).alias("nrows"), "draw", "rsd")


def lowest_of_sizes(cells: DataFrame, sizes: list[int], resamples: int, keep: float = 0.1, seed: int = 1, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """(col, nrows, resamples, lowest): per column and size the lowest share of the RSDs of `resamples` draws, all sizes in one plan."""
    each = rsd_of_draws(cells, sizes, F.lit(0), F.lit(resamples), seed, row, col, value).filter("rsd is not null")
    low = lowest(each, F.lit(round(resamples * keep)), col)
    return low.select(col, "nrows", F.lit(resamples).alias("resamples"), "lowest")


def lowest(each: DataFrame, most: Column, col: str = "col_id") -> DataFrame:
    """(col, nrows, lowest): of the draws (col, nrows, draw, rsd) the `most` lowest, ascending."""
    by = Window.partitionBy(col, "nrows").orderBy("rsd", "draw")
    return each.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") <= most).groupBy(col, "nrows").agg(F.sort_array(F.collect_list("rsd")).alias("lowest"))


def lowest_rsd(cells: DataFrame, size: int, resamples: int, keep: float = 0.1, seed: int = 1, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """lowest_of_sizes() of one size."""
    return lowest_of_sizes(cells, [size], resamples, keep, seed, row, col, value)


def merge(old: DataFrame, new: DataFrame, keep: float = 0.1, col: str = "col_id") -> DataFrame:
    """Two sets of null distributions of the same (col, nrows) as one: lists joined and sorted, the kept share of all draws left.

    The sets must come from different seeds; of one seed, top_up() draws only what is lacking.
    """
    both = old.unionByName(new).groupBy(col, "nrows").agg(F.sum("resamples").cast("int").alias("resamples"), F.flatten(F.collect_list("lowest")).alias("all"))
    return both.select(col, "nrows", "resamples", F.slice(F.sort_array("all"), F.lit(1), F.round(F.col("resamples") * keep).cast("int")).alias("lowest"))


def empirical_pvalue(observed: DataFrame, nulls: DataFrame, least_resamples: int = 1, cutoff: float | None = 0.05, col: str = "col_id", value: str = "rsd", also: list[str] | None = None) -> DataFrame:
    """(also, col, pval) of observed (col, value) against the stored lowest values.

    The share of all draws that are not above the observation; if that reaches the stored share, the stored share to 2 places; if
    none is, 1 / resamples. Columns without enough draws, and missing observations, are not tested.
    """
    both = observed.filter(F.col(value).isNotNull()).join(nulls.filter(F.col("resamples") >= least_resamples).select(col, "resamples", "lowest"), col)
    below = F.size(F.filter("lowest", lambda y: y <= F.col(value)))
    share, stored = below / F.col("resamples"), F.size("lowest") / F.col("resamples")
    done = both.select(*(also or []), col, F.when(share >= stored, F.round(stored, 2)).when(below == 0, 1 / F.col("resamples")).otherwise(share).alias("pval"))
    return done if cutoff is None else done.filter(F.col("pval") <= cutoff)


def missing_nulls(wanted: DataFrame, nulls: DataFrame, size: int, resamples: int, col: str = "col_id") -> DataFrame:
    """Columns without a stored distribution of this size and so many draws."""
    return wanted.join(nulls.filter((F.col("nrows") == size) & (F.col("resamples") >= resamples)).select(col), col, "left_anti")


#: Columns of a stored record beyond (col, nrows): the seed, the draws 0 .. resamples - 1 that it has, how many values it may grow to keep, and these.
STORED = ("seed", "resamples", "reserve", "lowest")


def shortfall(wanted: DataFrame, stored: DataFrame | None, resamples: int, keep: float, seed: int = 1, col: str = "col_id") -> DataFrame:
    """(col, nrows, first, count) of the draws that records of the wanted (col, nrows) lack to have `resamples`.

    A record of another seed, or one that reserved too few values to know all it should keep now, is drawn from its first draw on.
    """
    if stored is None:
        return wanted.select(col, "nrows", F.lit(0).cast("long").alias("first"), F.lit(resamples).cast("long").alias("count"))
    both = wanted.join(stored.select(col, "nrows", "seed", "resamples", "reserve"), [col, "nrows"], "left")
    usable = (F.col("seed") == seed) & (F.col("reserve") >= round(resamples * keep))
    first = F.when(usable, F.least("resamples", F.lit(resamples))).otherwise(0).cast("long")
    # A record that has more draws than are wanted stays as it is.
    return both.withColumn("first", F.coalesce(first, F.lit(0).cast("long"))).withColumn("count", resamples - F.col("first")).filter("count > 0").select(col, "nrows", "first", "count")


def top_up(stored: DataFrame | None, cells: DataFrame, wanted: DataFrame, resamples: int, keep: float = 0.1, seed: int = 1, reserve: int | None = None, row: str = "row_id", col: str = "col_id", value: str = "raw") -> DataFrame:
    """The new records (col, nrows, *STORED) of the wanted (col, nrows) that had fewer draws than `resamples`, none else.

    Draws are numbered, and a record has those from 0 on, so only the numbers that it lacks are drawn, and no number twice. A record
    holds its `reserve` lowest values (by default those that ten times the draws would keep), not only those that its draws now
    keep: so as long as it grows within that, it is equal to one that was drawn at once. Beyond, it is drawn anew from the start.
    """
    most = max(reserve or 0, round(resamples * keep)) if reserve else round(10 * resamples * keep)
    lacking = cut(shortfall(wanted, stored, resamples, keep, seed, col))
    out = None
    # Records that lack the same draws are drawn together, all sizes from one sequence per column.
    spans = lacking.groupBy("first", "count").agg(F.sort_array(F.collect_set("nrows")).alias("sizes")).collect()
    for span in spans:
        own = lacking.filter((F.col("first") == span["first"]) & (F.col("count") == span["count"])).select(col, "nrows")
        here = cells.join(own.select(col).distinct(), col, "left_semi")
        each = rsd_of_draws(here, span["sizes"], F.lit(span["first"]), F.lit(span["count"]), seed, row, col, value).filter("rsd is not null").join(own, [col, "nrows"], "left_semi")
        new = lowest(each.select(col, "nrows", "draw", "rsd"), F.lit(most), col)
        done = own.join(new, [col, "nrows"])
        if stored is not None and span["first"] > 0:
            before = stored.select(col, "nrows", F.col("lowest").alias("__before"), F.col("reserve").alias("__reserve"))
            done = own.join(before, [col, "nrows"]).join(new, [col, "nrows"], "left")
            # What a record reserved before bounds what it knows.
            size = F.least("__reserve", F.lit(most))
            merged = F.slice(F.array_sort(F.concat("__before", F.coalesce("lowest", F.array().cast("array<double>")))), F.lit(1), size)
            done = done.select(col, "nrows", merged.alias("lowest"), size.alias("reserve"))
        else:
            done = done.withColumn("reserve", F.lit(most))
        done = done.select(col, "nrows", F.lit(seed).alias("seed"), F.lit(resamples).alias("resamples"), F.col("reserve").cast("int").alias("reserve"), "lowest")
        out = done if out is None else out.unionByName(done)
    if out is None:
        empty = lacking.select(col, "nrows", F.lit(seed).alias("seed"), F.lit(0).alias("resamples"), F.lit(0).alias("reserve"), F.array().cast("array<double>").alias("lowest"))
        return empty.filter(F.lit(False))
    return out


def kept_share(stored: DataFrame, keep: float = 0.1, col: str = "col_id") -> DataFrame:
    """(col, nrows, resamples, lowest) of stored records, with the share that their draws keep."""
    return stored.select(col, "nrows", "resamples", F.slice("lowest", F.lit(1), F.round(F.col("resamples") * keep).cast("int")).alias("lowest"))


def store_nulls(table: Versioned, cells: DataFrame, wanted: DataFrame, resamples: int, keep: float = 0.1, seed: int = 1, reserve: int | None = None, col: str = "col_id") -> DataFrame:
    """Draw what the table's records lack for the wanted (col, nrows), write the sizes that changed, and return the records as kept_share().

    The table's part is its nrows. Sizes without a shortfall are neither read nor written.
    """
    since = table.version()
    stored = table.read(since)
    new = cut(top_up(stored, cells, wanted, resamples, keep, seed, reserve, col=col))
    if new.limit(1).count():
        table.upsert(new, [col, "nrows"])
    done = table.read()
    return kept_share((new if done is None else done).join(wanted.select(col, "nrows"), [col, "nrows"], "left_semi"), keep, col)
