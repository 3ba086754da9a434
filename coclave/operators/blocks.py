"""Choosing columns for runs by blocks, and reports on what was chosen."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coclave.functions.stats import uniform


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, by weight: the largest u^(1/w). Weights of 0 and less are never drawn."""
    drawn = df.withColumn("__w", weight).filter("__w > 0").withColumn("__k", F.pow(uniform(seed, F.col(key)), 1 / F.col("__w")))
    return drawn.orderBy(F.col("__k").desc(), key).limit(n).drop("__w", "__k")


def split_bins(n: int, parts: int) -> list[range]:
    """0..n-1 in `parts` consecutive ranges of near-equal length, cut at i * n // parts."""
    return [range(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def bin_of(position: Column, n: Column, parts: int) -> Column:
    """The bin of split_bins that holds a position."""
    guess = F.floor((position + 1) * parts / n).cast("long")
    return F.when(F.floor(guess * n / parts) > position, guess - 1).otherwise(guess)


def set_combinations(sets: list[str]) -> list[tuple[str, ...]]:
    """Every choice of some of the sets, and of none."""
    return [c for k in range(len(sets) + 1) for c in itertools.combinations(sets, k)]


def block_pairs(groups: DataFrame) -> DataFrame:
    """(x, y) for every ordered pair of different blocks that stand in one ':::'-joined group."""
    listed = groups.select(F.col("group"), F.explode(F.split("group", ":::")).alias("block"))
    a, b = listed.withColumnRenamed("block", "x"), listed.withColumnRenamed("block", "y")
    return a.join(b, "group").filter("x <> y").select("x", "y").distinct()


def block_frequency(run_blocks: DataFrame, n_runs: int) -> DataFrame:
    """(block, freq): the share of runs that hold a block."""
    return run_blocks.distinct().groupBy("block").agg((F.count("*") / n_runs).alias("freq"))


def coinclusion(groups: DataFrame, run_blocks: DataFrame, n_runs: int) -> DataFrame:
    """For every ':::'-joined group: the shares of runs that hold some or all of its blocks, and how complete runs with some are."""
    listed = groups.select("group", F.explode(F.split("group", ":::")).alias("block"))
    sizes = listed.groupBy("group").agg(F.count_distinct("block").alias("size"))
    held = listed.join(run_blocks.select("run_id", "block").distinct(), "block").groupBy("group", "run_id").agg(F.count_distinct("block").alias("n"))
    per = held.join(sizes, "group").groupBy("group").agg(F.count("*").alias("some"), F.sum("n").alias("held"), F.sum((F.col("n") == F.col("size")).cast("int")).alias("all"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return sizes.join(per, "group", "left").select(
        "group",
        zero(F.col("some") / n_runs).alias("freq_single"),
        zero(F.try_divide(F.col("held"), F.col("size") * F.col("some"))).alias("freq_coinclusion"),
        zero(F.col("all") / n_runs).alias("max_coinclusion_all"),
        zero(F.try_divide(F.col("all"), F.col("some"))).alias("max_coinclusion_sub"),
    )


def inclusion_weights(groups: DataFrame, weight: float = 2.0) -> DataFrame:
    """(x, y, weight), symmetric: blocks that stand in one group go together with this weight."""
    return block_pairs(groups).withColumn("weight", F.lit(float(weight)))


def random_exclusions(sizes: dict[str, int], n: int, columns: int, share: float = 0.1, seed: int = 1) -> list[list[str]]:
    """n groups of blocks drawn with replacement, each until its blocks have round(share * columns) columns together.

    A block may stand in a group twice and then counts twice. No block has a column: ValueError, as no group would ever fill up.
    """
    rng, wanted, names = random.Random(seed), round(share * columns), list(sizes)
    if wanted > 0 and not any(sizes.values()):
        raise ValueError("the blocks have no columns")
    groups = []
    for _ in range(n):
        group: list[str] = []
        while sum(sizes[b] for b in group) < wanted:
            group.append(rng.choice(names))
        groups.append(group)
    return groups


class Picker:
    """Chooses the blocks of runs one after another, by weights that follow what has been chosen.

    A block that is in a share r of runs weighs 1 + 1e-9 - r, and times the sum of `together` over the run's blocks so far where that
    is not 0. An exclusion group that has been left out by a share r weighs (1 + 1e-9 - r) ** |share_excluded - r|. With each choice
    all blocks of the run so far count once more. Each choice depends on those before it, so this is a loop over block names on the
    driver; no rows are touched.
    """

    def __init__(self, blocks: dict[str, list[str]], exclusions: list[list[str]], n_runs: int, together: dict[tuple[str, str], float] | None = None, share_excluded: float = 0.25, seed: int = 1):
        self.blocks, self.exclusions, self.step = blocks, exclusions, 1 / n_runs
        self.together, self.share, self.rng = together or {}, share_excluded, random.Random(seed)
        self.inside, self.outside = dict.fromkeys(blocks, 0.0), [0.0] * len(exclusions)

    def draw(self, weights: dict) -> object:
        return max(weights, key=lambda k: self.rng.random() ** (1 / weights[k]) if weights[k] > 0 else -1.0)

    def weight(self, block: str, chosen: list[str]) -> float:
        with_chosen = sum(self.together.get((b, block), 0.0) for b in chosen)
        return (1 + 1e-9 - self.inside[block]) * (with_chosen or 1.0)

    def run(self, wanted: int) -> dict:
        left_out: list[str] = []
        if self.exclusions:
            k = self.draw({i: (1 + 1e-9 - min(r, 1.0)) ** abs(self.share - r) for i, r in enumerate(self.outside)})
            left_out = self.exclusions[k]
            self.outside[k] += self.step
        barred = {c for b in left_out for c in self.blocks.get(b, [])}
        open_ = [b for b in self.blocks if b not in left_out]
        chosen: list[str] = []
        cols: dict[str, None] = {}
        while len(cols) < wanted and open_:
            block = self.draw({b: self.weight(b, chosen) for b in open_})
            before = len(cols)
            chosen.append(block)
            cols.update(dict.fromkeys(c for c in self.blocks[block] if c not in barred))
            for b in set(chosen):
                self.inside[b] += self.step
            if len(cols) == before:
                break
        return {"blocks": chosen, "cols": list(cols), "excluded": ":::".join(left_out)}


def pick_columns(blocks: dict[str, list[str]], exclusions: list[list[str]], n_runs: int, mean: float, spread: float, share_excluded: float = 0.25, seed: int = 1, together: dict[tuple[str, str], float] | None = None) -> list[dict]:
    """Columns for each run: {"blocks", "cols", "excluded"}.

    A run leaves out the columns of one exclusion group and adds blocks by Picker's weights until it has round(mean + spread *
    Gamma(1, 2)) columns, or a block adds none.
    """
    picker = Picker(blocks, exclusions, n_runs, together, share_excluded, seed)
    return [picker.run(round(mean + spread * picker.rng.gammavariate(1, 2))) for _ in range(n_runs)]
