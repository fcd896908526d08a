"""Leakage-safe splits and samples. Orders come from md5 of seed and key, so a retried task draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.ranks import hash_order, hash_rank


def stratified_half_split(df: DataFrame, by: str, item_id: str, seed: str) -> DataFrame:
    """Adds part: the first floor(n/2) rows of each class in hash order are 'train', the rest 'calib'."""
    ranked = hash_rank(df, hash_order(seed, F.col(item_id)), [by], item_id, "_r", "_t")
    return ranked.withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_t") / 2), "train").otherwise("calib")).drop("_r", "_t")


def sample_cap_per_class(df: DataFrame, cap: int, by: str, item_id: str, seed: str) -> DataFrame:
    """At most `cap` rows per class in hash order. The rank limit is applied before the shuffle, so a class that holds a
    third of the rows sends at most `cap` rows per task."""
    order = Window.partitionBy(by).orderBy("_h", item_id)
    return (df.withColumn("_h", hash_order(seed, F.col(item_id))).withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") <= cap).drop("_h", "_r"))


def ranked_units(df: DataFrame, unit: str, seed: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct units with their place in hash order and their number."""
    units = df.select(*by, unit).distinct()
    return hash_rank(units, hash_order(seed, F.col(unit)), by, unit, "unit_rank", "n_units")


def group_holdout(df: DataFrame, unit: str, share: float, seed: str) -> DataFrame:
    """Adds split: floor(share x units) whole units become 'val', the others 'train'."""
    units = ranked_units(df, unit, seed).select(unit, F.when(
        F.col("unit_rank") <= F.floor(F.col("n_units") * F.lit(share)), "val").otherwise("train").alias("split"))
    return df.drop("split").join(units, unit)


def group_kfold(df: DataFrame, unit: str, label: str, folds: int, seed: str) -> DataFrame:
    """Adds fold: units are dealt out in hash order within a class. A unit that meets several classes is dealt once,
    with its smallest class, so all its rows share a fold."""
    owner = df.groupBy(unit).agg(F.min(label).alias("_owner"))
    dealt = hash_rank(owner, hash_order(seed, F.col(unit)), ["_owner"], unit, "_r").select(
        unit, F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int").alias("fold"))
    return df.drop("fold").join(dealt, unit)


def seeded_pool_split(df: DataFrame, unit: str, seeds: Sequence[int], share: float = 0.5) -> DataFrame:
    """(seed, rows..., in_pool): for each seed, half of the units form the pool, the other half is scored."""
    units = df.select(unit).distinct().withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    ranked = hash_rank(units, hash_order(F.col("seed"), F.col(unit)), ["seed"], unit, "_r", "_t")
    side = ranked.select("seed", unit, (F.col("_r") <= F.floor(F.col("_t") * F.lit(share))).alias("in_pool"))
    return df.join(side, unit)


def development_sealed_split(df: DataFrame, unit: str, share: float, seed: str, protected: DataFrame | None = None,
                             item_id: str = "item_id") -> DataFrame:
    """Adds part 'dev' / 'sealed' by unit; a unit with a protected row is always sealed. The quota counts all units."""
    units = df.select(unit).distinct()
    if protected is not None:
        forced = df.join(protected.select(item_id), item_id, "left_semi").select(unit).distinct().withColumn("_p", F.lit(True))
        units = units.join(forced, unit, "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    else:
        units = units.withColumn("_p", F.lit(False))
    order = F.concat(F.when(F.col("_p"), "1").otherwise("0"), hash_order(seed, F.col(unit)))
    ranked = hash_rank(units, order, (), unit, "_r", "_t", digits=4)
    part = ranked.select(unit, F.when(~F.col("_p") & (F.col("_r") <= F.round(F.col("_t") * F.lit(share))), "dev")
                         .otherwise("sealed").alias("part"))
    return df.join(part, unit)


def one_per_group(df: DataFrame, group: str, item_id: str, seed: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """One member per group, the first in hash order, with the place of its group in another hash order. A seed that is a column of
    `by` gives each of its values an order of its own."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    first = df.groupBy(*by, group).agg(F.min_by(item_id, hash_order(F.concat(s, F.lit("-member")), F.col(item_id))).alias(item_id))
    return hash_rank(first, hash_order(F.concat(s, F.lit("-group")), F.col(group)), by, group, "place")


def nested_prefixes(df: DataFrame, order: Column, sizes: Sequence[int], by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """For each size k the first k rows of one order, so the sets nest: rows with columns k and rn."""
    keyed = df.withColumn("_h", order)
    place = ["_h", *([tie] if tie else [])]
    if not by:
        keyed = keyed.orderBy(*place).limit(max(sizes))  # the k first rows are the feature
    scope = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*place)
    top = keyed.withColumn("rn", F.row_number().over(scope)).where(F.col("rn") <= max(sizes))
    wanted = F.array(*[F.lit(int(k)) for k in sizes])
    return top.drop("_h").withColumn("k", F.explode(F.filter(wanted, lambda k: k >= F.col("rn"))))


def per_key_shuffle(df: DataFrame, key: str, item: str, seed: str) -> DataFrame:
    """Adds position: a repeatable order of the items for each key."""
    order = hash_order(seed, F.concat_ws("|", F.col(key), F.col(item)))
    return hash_rank(df, order, [key], item, "position")


def copy_unit_key(label: Column, cluster: Column) -> Column:
    return F.concat_ws("-", label.cast("string"), cluster.cast("string"))


def conflict_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups whose rows carry more than one label: (group, n, labels)."""
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")


def leakage_filter(train: DataFrame, held_out: DataFrame, groups: DataFrame, label: str, item_id: str = "item_id",
                   group: str = "copy_group") -> DataFrame:
    """Training rows whose copy group holds neither a held-out row nor a label conflict."""
    member = groups.select(item_id, group)
    # each row once, whether it is a training row, a held-out row or both
    labelled = train.select(item_id, label).unionByName(held_out.select(item_id, label)).distinct().join(member, item_id)
    conflict = conflict_groups(labelled, group, label).select(group)
    touched = member.join(held_out.select(item_id), item_id, "left_semi").select(group).distinct()
    banned = conflict.unionByName(touched).distinct()
    return train.join(member, item_id).join(banned, group, "left_anti")


def straddling_units(df: DataFrame, unit: str, split: str) -> DataFrame:
    """Units that occur in more than one split; must be empty."""
    return (df.select(unit, split).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("splits")).where("splits > 1"))


def largest_remainder(strata: DataFrame, stratum: str, size: str, seats: int) -> DataFrame:
    """Proportional seats: whole parts first, the rest to the largest fractions. One row per stratum."""
    whole = Window.partitionBy(F.lit(0))
    shared = strata.withColumn("_s", F.col(size) * F.lit(seats) / F.sum(size).over(whole))
    parts = shared.withColumn("_f", F.floor("_s"))
    left = F.lit(seats) - F.sum("_f").over(whole)
    order = whole.orderBy(F.desc(F.round(F.col("_s") - F.col("_f"), 9)), stratum)
    return parts.withColumn("_left", left).withColumn("_r", F.row_number().over(order)).select(
        stratum, size, (F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("seats"))
