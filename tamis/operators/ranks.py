"""Exact ranks, prefix sums and quantiles that never sort one whole key, or the whole table, in one task.

The pattern is always the same: cut the order into many small ranges, count per range (combined before the shuffle),
turn the counts into offsets, and rank inside each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import cut_lineage


def hash_order(seed: str | int | Column, key: Column) -> Column:
    """A repeatable random order: md5 of seed and key."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit("|"), key.cast("string")))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equality join on `keys`, kept from the left side; the right side may derive from the left."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hash_rank(df: DataFrame, order: Column, by: Sequence[str] = (), tie: str | None = None, rank: str = "rn",
              total: str | None = None, digits: int = 3) -> DataFrame:
    """Row numbers 1..n per `by` in the order of an md5 text. The leading hex digits spread even a key that holds a
    third of the rows over 16^digits ranges."""
    by = list(by)
    keyed = df.withColumn("_hr_h", order).withColumn("_hr_p", F.substring("_hr_h", 1, digits))
    sizes = keyed.groupBy(*by, "_hr_p").agg(F.count(F.lit(1)).alias("_hr_c"))
    scope = Window.partitionBy(*(by or [F.lit(0)]))
    before = scope.orderBy("_hr_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_hr_p", F.coalesce(F.sum("_hr_c").over(before), F.lit(0)).alias("_hr_o"),
                           F.sum("_hr_c").over(scope).alias("_hr_t"))
    joined = join_on(keyed, offsets, [*by, "_hr_p"])
    inner = Window.partitionBy(*by, "_hr_p").orderBy("_hr_h", *([tie] if tie else []))
    out = joined.withColumn(rank, F.row_number().over(inner).cast("bigint") + F.col("_hr_o"))
    if total:
        out = out.withColumn(total, F.col("_hr_t"))
    return out.drop("_hr_h", "_hr_p", "_hr_o", "_hr_t")


def _placed(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows in order with their part `_op_part` and place `_op_place`, offsets of the parts). Spark cuts the order into ranges by a sample of the
    rows; as the last column tells rows apart, a value that very many share is several ranges. The ordered rows are stored, so
    that ranges and offsets are of one run."""
    terms = {f"_op_{n}": t for n, t in sums.items()}
    ordered = df.withColumns(terms) if terms else df
    rows = cut_lineage(ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_op_place", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_op_part": F.shiftright("_op_place", 33), "_op_place": F.col("_op_place").bitwiseAND(F.lit((1 << 33) - 1))})
    per = rows.groupBy("_op_part").agg(F.count(F.lit(1)).alias("_op_n"), *[F.sum(c).alias(f"_sum{c}") for c in terms])
    before = Window.partitionBy(F.lit(0)).orderBy("_op_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_op_part", F.coalesce(F.sum("_op_n").over(before), F.lit(0)).alias("_op_before"),
                         *[F.coalesce(F.sum(f"_sum{c}").over(before), F.lit(0)).alias(f"_before{c}") for c in terms])
    return rows, offsets  # one row per part


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Adds the place 1..n in the whole order; the last column of the order should tell the rows apart."""
    rows, offsets = _placed(df, order, {})
    return rows.join(F.broadcast(offsets), "_op_part").select(*df.columns, (F.col("_op_before") + F.col("_op_place") + 1).alias(rank))


def ordered_prefix(df: DataFrame, value: str, tie: str, sums: Mapping[str, Column], rank: str = "rank") -> DataFrame:
    """Rank (1 = largest value, ties by the smaller `tie`, compared in its own type) and inclusive running sums over the whole table."""
    rows, offsets = _placed(df, [F.col(value).desc(), F.col(tie).asc()], sums)
    inner = Window.partitionBy("_op_part").orderBy("_op_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(offsets), "_op_part")
    return joined.select(*df.columns, (F.col("_op_before") + F.col("_op_place") + 1).alias(rank),
                         *[(F.sum(f"_op_{n}").over(inner) + F.col(f"_before_op_{n}")).alias(n) for n in sums])


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 20_000) -> DataFrame:
    """Exact linear-interpolation quantiles, columns (by..., n, q0, q1, ...); nulls and NaN are left out.

    An approximate quantile brackets each target rank; everything below the bracket is only counted, and the values
    inside it are ranked after being combined by value.
    """
    by = list(by)
    base = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 5.0 / accuracy
    small = 4.0 / slack  # the bracket of a group below this size is the whole group
    lows, highs = [max(0.0, p - slack) for p in probs], [min(1.0, p + slack) for p in probs]
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", lows, accuracy).alias("_lo"), F.percentile_approx("_v", highs, accuracy).alias("_hi")]
    if by:
        few = F.col("_n") < small
        bracket = (
            base.groupBy(*by).agg(*ends)
            .select(*by, "_n", "_min", "_max", F.posexplode(F.arrays_zip("_lo", "_hi")).alias("_i", "_r"))
            .select(*by, "_n", "_i", F.when(few, F.col("_min")).otherwise(F.col("_r._lo")).alias("_lo"),
                    F.when(few, F.col("_max")).otherwise(F.col("_r._hi")).alias("_hi"))
        )
        keys, joined = by, join_on(base, bracket, by)
    else:
        row = base.agg(*ends).first()  # one row
        if row._n < small:
            exact = base.agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", [float(p) for p in probs]).alias("_q"))
            return exact.select("n", *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])
        spans = F.array(*[F.struct(F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi")) for lo, hi in zip(row._lo, row._hi)])
        keys = ["_g"]
        joined = base.select(F.lit(0).alias("_g"), "_v", F.lit(row._n).alias("_n"), F.posexplode(spans).alias("_i", "_r")).select(
            "_g", "_v", "_n", "_i", "_r.*")
    slots = (
        joined.where(F.col("_v") <= F.col("_hi"))
        .groupBy(*keys, "_i", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # one more shuffle by key serves the running counts and the final pick
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = slots.repartition(*keys).withColumn("_cum", F.sum("_c").over(upto))
    picks = [F.max("_n").alias("n")]
    for i, p in enumerate(probs):
        mine, pos = F.col("_i") == i, F.lit(float(p)) * (F.col("_n") - 1)
        picks += [F.min(F.when(mine & (F.col("_cum") > F.floor(pos)), F.col("_x"))).alias(f"_a{i}"),
                  F.min(F.when(mine & (F.col("_cum") > F.ceil(pos)), F.col("_x"))).alias(f"_b{i}"),
                  F.max(F.when(mine & F.col("_x").isNull(), F.col("_c")).otherwise(0)).alias(f"_w{i}"),
                  F.max(F.when(mine, F.col("_cum"))).alias(f"_r{i}")]
    found = ranked.groupBy(*keys).agg(*picks)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        inside = (F.col(f"_w{i}") <= F.floor(pos)) & (F.col(f"_r{i}") > F.ceil(pos))
        exact = F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (pos - F.floor(pos))
        out.append(F.when(inside, exact).otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).alias(f"q{i}"))
    return found.select(*by, "n", *out)


def quantile(df: DataFrame, value: Column, p: float) -> float | None:
    """One exact quantile as a number."""
    row = exact_quantiles(df, value, [p]).first()
    return None if row is None else row.q0
