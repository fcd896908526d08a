"""People and models scored on the same items with one measure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.ranks import exact_quantiles, join_on


def answers_with_key(answers: DataFrame, key: DataFrame, rater: str = "rater", item: str = "item_id") -> DataFrame:
    """Every rater with every item of the key, null where an answer is missing. Items outside the key are dropped.

    The answers that exist are joined on the item. The result holds every rater with every item by definition; the
    combinations are made by an equality join over slots, each rater in one slot and each item in all of them."""
    have = answers.join(key, item)
    slots = 16
    raters = answers.select(rater).distinct().withColumn("_slot", F.pmod(F.xxhash64(rater), F.lit(slots)).cast("int"))
    offered = key.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    wanted = offered.join(raters, "_slot").select(*key.columns, rater)
    missing = wanted.join(have.select(rater, item), [rater, item], "left_anti")
    return have.select(rater, *key.columns, "answer").unionByName(
        missing.select(rater, *key.columns, F.lit(None).cast("string").alias("answer")))


def _is_answered():
    return F.col("answer").isNotNull() & (F.col("answer") != "not_sure")


def answer_cells(answers: DataFrame, key: DataFrame, rater: str = "rater", item: str = "item_id") -> DataFrame:
    """(rater, the columns of the key but the item, answer, n): how many items of each kind got each answer; a null answer counts the
    items without one. The measures need no more than this, so the product of raters and items is never built: what a rater
    hasn't answered is the size of the kind less what is answered. The kinds (levels x truths) reach the driver."""
    kinds = [c for c in key.columns if c != item]
    given = answers.select(rater, item, "answer").join(key, item).groupBy(rater, *kinds, "answer").agg(F.count(F.lit(1)).alias("n"))
    sizes = key.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.collect()  # one row per kind
    shape = sizes.schema.simpleString()
    offered = answers.select(rater).distinct().withColumn("_k", F.explode(F.array(*[F.struct(*[
        F.lit(v).cast(sizes.schema[c].dataType).alias(c) for c, v in r.asDict().items()]) for r in rows]) if rows else F.array().cast(f"array<{shape}>")))
    had = given.groupBy(rater, *kinds).agg(F.sum("n").alias("_had"))
    missing = join_on(offered.select(rater, "_k.*"), had, [rater, *kinds], "left").withColumn(
        "n", F.col("n") - F.coalesce("_had", F.lit(0))).where("n > 0")
    return given.unionByName(missing.select(rater, *kinds, F.lit(None).cast("string").alias("answer"), "n"))


def _items(test: Column | None = None) -> Column:
    """Items in the cells that pass."""
    return F.sum(F.when(test, F.col("n")).otherwise(0) if test is not None else F.col("n"))


def _share(test: Column, among: Column | None = None) -> Column:
    whole = among if among is not None else F.lit(True)
    return _items(whole & test) / F.nullif(_items(whole), F.lit(0))


def rater_score(cells: DataFrame, rater: str = "rater") -> DataFrame:
    """Measures per rater from `answer_cells`."""
    ok, right = _is_answered(), F.coalesce(F.col("answer") == F.col("truth"), F.lit(False))
    same_side = F.coalesce(F.col("answer") == "healthy", F.lit(False)) == (F.col("truth") == "healthy")
    return cells.groupBy(rater).agg(
        _items().alias("n"), _items(ok).alias("n_answered"), _share(ok).alias("share_answered"), _share(right, ok).alias("acc_answered"),
        _share(same_side, ok).alias("healthy_vs_problem_answered"), _share(ok & right).alias("correct_of_all"))


def score_by_level(cells: DataFrame, rater: str = "rater", level: str = "level") -> DataFrame:
    ok, right = _is_answered(), F.coalesce(F.col("answer") == F.col("truth"), F.lit(False))
    problem = F.coalesce(~F.col("answer").isin("healthy", "not_sure"), F.lit(False))
    return cells.groupBy(rater, level).agg(
        _items().alias("n"), _items(ok).alias("n_answered"), _share(ok & right).alias("correct_of_all"),
        _share(right, ok).alias("acc_answered"), _share(problem).alias("called_a_problem"))


def answer_counts(cells: DataFrame, rater: str = "rater") -> DataFrame:
    return cells.groupBy(rater, F.coalesce("answer", F.lit("missing")).alias("answer")).agg(_items().alias("n"))


def rater_effort(answers: DataFrame, rater: str = "rater") -> DataFrame:
    """Median seconds of the answered items, total minutes, changed answers."""
    given = answers.where("answer is not null")
    mid = exact_quantiles(given, F.col("seconds"), [0.5], [rater]).select(rater, F.col("q0").alias("median_seconds"))
    total = answers.groupBy(rater).agg(
        (F.sum(F.when(F.col("answer").isNotNull(), F.col("seconds")).otherwise(0.0)) / 60).alias("total_minutes"),
        F.count_if("changed").alias("n_changed"))
    return total.join(mid, rater, "left")


def rater_pairs(answers: DataFrame, rater: str = "rater", item: str = "item_id", items_per_block: int = 50_000) -> DataFrame:
    """Per unordered pair of raters: (rater_a, rater_b, n_items, n_same, n_both, n_same_side) over the items both were
    shown. Items are cut by hash into blocks; a block counts agreements as products of answer matrices and sends one row
    per pair of raters, so pairs of answers are never listed."""
    blocks = max(1, -(-answers.count() // items_per_block))
    work = answers.select(F.pmod(F.xxhash64(item), F.lit(blocks)).alias("block"), F.col(rater).cast("string").alias("r"),
                          F.col(item).cast("string").alias("i"), "answer")

    def count(table: pa.Table) -> pa.Table:
        names, r = np.unique(np.array(table.column("r").to_pylist(), dtype=object), return_inverse=True)
        items, i = np.unique(np.array(table.column("i").to_pylist(), dtype=object), return_inverse=True)
        given = np.array(["" if a is None else a for a in table.column("answer").to_pylist()], dtype=object)
        shape = (len(names), len(items))

        def product(rows: np.ndarray) -> np.ndarray:
            m = np.zeros(shape, dtype=np.float64)
            m[r[rows], i[rows]] = 1.0
            return m @ m.T

        shown = product(np.ones(len(r), bool))
        same = sum(product(given == a) for a in np.unique(given))
        sure = (given != "") & (given != "not_sure")
        both = product(sure)
        side = product(sure & (given == "healthy")) + product(sure & (given != "healthy"))
        x, y = np.nonzero(np.triu(shown, 1))
        cols = [pa.array(m[x, y].astype(np.int64)) for m in (shown, same, both, side)]
        return pa.table([pa.array(names[x].tolist(), pa.string()), pa.array(names[y].tolist(), pa.string()), *cols],
                        names=["rater_a", "rater_b", "n_items", "n_same", "n_both", "n_same_side"])

    counts = work.groupBy("block").applyInArrow(
        count, "rater_a string, rater_b string, n_items bigint, n_same bigint, n_both bigint, n_same_side bigint")
    return counts.groupBy("rater_a", "rater_b").agg(*[F.sum(c).alias(c) for c in ("n_items", "n_same", "n_both", "n_same_side")])


def pairwise_agreement(pairs: DataFrame) -> DataFrame:
    """Shares of equal answers, and of equal healthy-or-problem answers where both answered."""
    return pairs.select("rater_a", "rater_b", (F.col("n_same") / F.col("n_items")).alias("same_answer"),
                        (F.col("n_same_side") / F.nullif(F.col("n_both"), F.lit(0))).alias("same_healthy_vs_problem"))


def latest_per_key(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The newest row per key, the first by `tie` on equal stamps, as one combinable aggregation."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct((-F.col(stamp)).alias("s"), F.col(tie).alias("t"))).alias("_r"))
    return best.select("_r.*")
