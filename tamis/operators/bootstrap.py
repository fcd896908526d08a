"""Group bootstrap: whole groups are drawn with replacement, each draw of a group counts as one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1_024
BLOCK_GROUPS = 50_000


def _block_draws(sizes: np.ndarray, block: int, reps: int, seed: int) -> np.ndarray:
    """How many of the n draws of each repetition fall in a block. The n draws are split down a binary tree with seeds
    that depend only on the node, so every task finds the same numbers without seeing the others."""
    lo, hi, node = 0, len(sizes), 1
    draws = np.full(reps, int(sizes.sum()), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        whole = sizes[lo:hi].sum()
        left = np.random.default_rng([seed, node]).binomial(draws, sizes[lo:mid].sum() / whole if whole else 0.0)
        if block < mid:
            draws, hi, node = left, mid, 2 * node
        else:
            draws, lo, node = draws - left, mid, 2 * node + 1
    return draws


def replicates(df: DataFrame, group: str, measures: Mapping[str, tuple[Column, Column]], reps: int = 1000, seed: int = 11) -> DataFrame:
    """(rep, measure, v): each measure in every repetition; repetition 0 is the data itself. Rows are first combined into one line per
    group; groups are cut by hash into blocks, each block draws its own share and sends one line of sums per repetition."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"{k}_{m}") for m, (hit, base) in measures.items()
                                                                 for k, c in (("h", F.count_if(hit & base)), ("b", F.count_if(base)))])
    names = list(measures)
    stats = F.array(*[(F.col(f"{k}_{m}") / F.col("_n")).cast("double") for m in names for k in ("h", "b")])
    n_groups = per.count()
    n_blocks = int(min(MAX_BLOCKS, max(1, -(-n_groups // BLOCK_GROUPS))))
    blocks = per.select(F.pmod(F.xxhash64(group), F.lit(n_blocks)).cast("int").alias("block"),
                        F.xxhash64(group).alias("k"), stats.alias("s"))
    found = {r.block: r.n for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block
    sizes = np.array([found.get(i, 0) for i in range(n_blocks)], dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast(sizes)
    width = 2 * len(names)

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        block = table.column("block")[0].as_py()
        flat = table.column("s").combine_chunks().flatten().to_numpy().reshape(-1, width)
        wanted = _block_draws(shared.value, block, reps, seed)
        rng = np.random.default_rng([seed, 7, block])
        sums = np.empty((reps, width))
        for r in range(reps):
            sums[r] = np.bincount(rng.integers(0, len(flat), wanted[r]), minlength=len(flat)) @ flat
        sums = np.vstack([flat.sum(axis=0), sums])
        rep, col = np.indices(sums.shape)
        return pa.table({"rep": pa.array(rep.ravel().astype(np.int32)), "i": pa.array(col.ravel().astype(np.int32)),
                         "x": pa.array(sums.ravel())})

    drawn = blocks.groupBy("block").applyInArrow(draw, "rep int, i int, x double").groupBy("rep", "i").agg(F.sum("x").alias("x"))
    label = F.get(F.array(*[F.lit(m) for m in names]), F.floor(F.col("i") / 2).cast("int"))
    return drawn.groupBy("rep", label.alias("measure")).agg(
        (F.max(F.when(F.col("i") % 2 == 0, F.col("x")))
         / F.nullif(F.max(F.when(F.col("i") % 2 == 1, F.col("x"))), F.lit(0.0))).alias("v"))


def _bounds(value: DataFrame, by: Sequence[str], interval: Sequence[float], column: str = "v") -> DataFrame:
    """Value and interval; the quantiles run over the fixed number of repetitions."""
    own, drawn = F.when(F.col("rep") == 0, F.col(column)), F.when(F.col("rep") > 0, F.col(column))
    return value.groupBy(*by).agg(F.max(own).alias("value"), F.percentile(drawn, float(interval[0])).alias("low"),
                                  F.percentile(drawn, float(interval[1])).alias("high"))


def group_bootstrap(df: DataFrame, group: str, measures: Mapping[str, tuple[Column, Column]], reps: int = 1000,
                    seed: int = 11, interval: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """(measure, value, low, high) over whole groups."""
    return _bounds(replicates(df, group, measures, reps, seed), ["measure"], interval)


def paired_bootstrap(df: DataFrame, model: str, names: tuple[str, str], group: str, measures: Mapping[str, tuple[Column, Column]], reps: int = 1000,
                     seed: int = 11, interval: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """(measure, first, second, difference, low, high): two models that decided the same rows, told apart by the column `model`.

    Both are drawn together: a repetition takes the same groups for either model, so the interval is that of the difference
    second - first and not of two independent samples. Equal decisions give a difference of exactly 0 in every repetition. A measure without a base in a
    repetition leaves it out."""
    own = {(i, m): (F.col(model) == name) & base for i, name in enumerate(names) for m, (_, base) in measures.items()}
    both = {f"{i}:{m}": (measures[m][0], base) for (i, m), base in own.items()}
    value = replicates(df, group, both, reps, seed).select("rep", F.split("measure", ":", 2).alias("p"), "v")
    pair = value.groupBy("rep", F.col("p")[1].alias("measure")).agg(*[F.max(F.when(F.col("p")[0] == str(i), F.col("v"))).alias(f"v{i}") for i in (0, 1)])
    found = _bounds(pair.withColumn("d", F.col("v1") - F.col("v0")), ["measure"], interval, "d").withColumnRenamed("value", "difference")
    at_zero = pair.where("rep = 0").select("measure", F.col("v0").alias("first"), F.col("v1").alias("second"))
    return at_zero.join(found, "measure").select("measure", "first", "second", "difference", "low", "high")
