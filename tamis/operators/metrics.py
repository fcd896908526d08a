"""Evaluation measures as one or two aggregations. Empty denominators give null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.ranks import exact_quantiles, ordered_prefix


def share(hit: Column, base: Column | None = None) -> Column:
    """Share of the base rows that are hits; null when there is no base row."""
    if base is None:
        return F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0))


def share_or_zero(hit: Column, base: Column) -> Column:
    return F.count_if(hit & base) / F.greatest(F.lit(1), F.count_if(base))


def rule_metrics(decided: DataFrame, truth: str = "class_idx", by: Sequence[str] = (), healthy: int = 0,
                 target: int = 1) -> DataFrame:
    """The full decision rule on rows of known class, in one pass."""
    t, top, forced, ans = F.col(truth), F.col("top"), F.col("forced"), F.col("answered")
    conf, fam, oth = F.col("confident"), F.col("familiar"), F.col("routed")
    is_target, is_healthy = t == target, t == healthy
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(ans).alias("coverage"),
        share(~ans).alias("not_sure"),
        share(top == t, ans).alias("acc_answered"),
        share(forced == t).alias("acc_all"),
        share(forced == t, ~ans).alias("acc_not_sure_if_forced"),
        share((top == healthy) == is_healthy, ans).alias("healthy_vs_problem_answered"),
        share_or_zero((top == target) & ans, is_target).alias("target_named"),
        share_or_zero((top != healthy) & ans, is_healthy).alias("healthy_flagged"),
        share_or_zero(top == target, ans & is_target).alias("sensitivity_answered"),
        share_or_zero(top == target, ans & is_healthy).alias("false_positive_rate_answered"),
        F.avg("max_prob").alias("mean_confidence"),
        share(~conf & fam & ~oth).alias("not_sure_low_confidence"),
        share(~fam & ~oth).alias("not_sure_unfamiliar"),
        share(oth).alias("routed_other"),
        share_or_zero(oth, is_target).alias("target_routed_other"),
        share_or_zero(oth, is_healthy).alias("healthy_routed_other"))


def out_of_scope_metrics(decided: DataFrame, by: Sequence[str] = (), healthy: int = 0, target: int = 1) -> DataFrame:
    """Rows of no known class: share sent to a person, by reason, and what the answered ones are called."""
    ans, fam, oth, conf, top = (F.col(c) for c in ("answered", "familiar", "routed", "confident", "top"))
    shares = decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(~ans).alias("not_sure"),
        share(~conf & fam & ~oth).alias("not_sure_low_confidence"), share(~fam & ~oth).alias("not_sure_unfamiliar"),
        share(oth).alias("routed_other"), share(ans & (top == target)).alias("called_target"),
        share(ans & (top == healthy)).alias("called_healthy"))
    return shares


def answered_as(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Map of answered class to count, as sorted (class, n) entries: one entry per class."""
    per = decided.where("answered").groupBy(*by, "top").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("top", "c")))).alias("answered_as"))


def ece(df: DataFrame, correct: Column, confidence: str = "max_prob", bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a confidence of exactly zero is in no bin but counts in n."""
    kept = df.select(*by, F.col(confidence).alias("_p"), correct.cast("int").alias("_c"))
    per = kept.groupBy(*by, F.when(F.col("_p") > 0, F.ceil(F.col("_p") * bins).cast("int")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_k"), F.sum("_p").alias("_s"))
    gap = F.when(F.col("_b").isNotNull(), F.abs(F.col("_k") - F.col("_s"))).otherwise(0.0)
    return per.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(gap) / F.sum("_n")).alias("ece"))


def confusion(decided: DataFrame, classes: Sequence[int], truth: str = "class_idx", predicted: str = "top") -> DataFrame:
    table = decided.groupBy(truth).pivot(predicted, [int(c) for c in classes]).agg(F.count(F.lit(1)))
    return table.select(truth, *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes])


def weighted_shares(df: DataFrame, measures: Mapping[str, tuple[Column, Column]], group: str | None = None,
                    by: Sequence[str] = (), means: Mapping[str, Column] | None = None) -> DataFrame:
    """Shares in which every group counts once: a row weighs 1 / (rows of its group in this subset).

    The weight never has to be joined to the rows: counts per group are combined before the shuffle and then divided by
    the size of the group. Without `group` every row weighs 1.
    """
    means = means or {}
    terms: dict[str, Column] = {}
    for name, (hit, base) in measures.items():
        terms[f"h_{name}"] = F.count_if(hit & base)
        terms[f"b_{name}"] = F.count_if(base)
    for name, value in means.items():
        terms[f"m_{name}"] = F.sum(value)
    keys = [*by, *([group] if group else [])]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in terms.items()])
    w = F.lit(1.0) / F.col("_n") if group else F.lit(1.0)
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * w).alias("n_effective"),
        *[(F.sum(F.col(f"h_{m}") * w) / F.nullif(F.sum(F.col(f"b_{m}") * w), F.lit(0.0))).alias(m) for m in measures],
        *[(F.sum(F.col(f"m_{m}") * w) / F.sum(F.col("_n") * w)).alias(m) for m in means])


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """Adds weight = 1 / rows of the group within this subset. Sizes are combined first and joined back."""
    sizes = df.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(sizes, group)


def standard_measures(truth: Column, healthy: int = 0, target: int = 1) -> dict[str, tuple[Column, Column]]:
    top, ans, every = F.col("top"), F.col("answered"), F.lit(True)
    right, healthy_row = ans & (top == truth), truth == healthy
    return {
        "answered_share": (ans, every),
        "correct_of_answered": (right, ans),
        "correct_of_all": (right, every),
        "forced_correct": (F.col("forced") == truth, every),
        "target_named": (ans & (top == target), truth == target),
        "healthy_flagged": (ans & (top != healthy), healthy_row),
        "sick_called_a_problem": (ans & (top != healthy), ~healthy_row),
        "healthy_vs_problem_of_answered": ((top == healthy) == healthy_row, ans),
        "not_sure_low_confidence": (F.col("reason") == "low_confidence", every),
        "not_sure_unfamiliar": (F.col("reason") == "unfamiliar", every),
        "routed_as_other": (F.col("reason").isin("other", "other_problem"), every),
    }


def auroc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_pos, n_neg, auroc): Mann-Whitney area with ties counted half, one row, or one per value of `by`. Rows are combined by score
    value first; the prefix sums over the distinct values are range-partitioned."""
    per = df.select(*by, F.col(score).alias("_score"), positive.alias("_y")).where("_score is not null").groupBy(*by, "_score").agg(
        F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_q"))
    key = "_score"
    if by:  # one order over all: group by group, and in each by score; the sums of the groups before are taken off again
        key = "_place"
        per = per.withColumn(key, F.struct(*by, "_score"))
    run = ordered_prefix(per, key, key, {"_above": F.col("_q")}, rank="_rank")
    # every positive beats the negatives below it and half of those at its value
    positives = F.col("_p").cast("double")
    area = F.sum(positives * (F.col("_above") - F.col("_q") / 2))
    pos, neg = F.sum("_p"), F.sum("_q")
    before = F.min(F.col("_above") - F.col("_q")) if by else F.lit(0)
    pairs = F.nullif(pos.cast("double") * neg.cast("double"), F.lit(0.0))
    return run.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), (1 - (area - pos * before) / pairs).alias("auroc"))


def risk_coverage(df: DataFrame, item_id: str, correct: Column, confidence: str = "max_prob") -> DataFrame:
    """Every row with its rank by confidence, coverage and running accuracy."""
    base = df.select(item_id, F.col(confidence).alias("_p"), correct.cast("int").alias("_c"))
    run = ordered_prefix(base, "_p", item_id, {"_hits": F.col("_c")}, rank="place")
    return run.select(item_id, "place", (F.col("_hits") / F.col("place")).alias("accuracy"))


def summarise_runs(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd over folds or seeds; NaN and null runs are left out."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in measures]
    aggs = [f(c).alias(f"{c}{s}") for c in measures for f, s in ((F.avg, "_mean"), (F.stddev_pop, "_sd"))]
    return df.select(*by, *clean).groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def group_size_profile(df: DataFrame, group: str) -> DataFrame:
    """Groups, singletons, median, p90, largest. Sizes are counted first, so the quantiles see few distinct values."""
    return group_size_counts(df, group).agg(
        F.sum("groups").alias("n_groups"), F.sum(F.when(F.col("size") == 1, F.col("groups")).otherwise(0)).alias("singletons"),
        F.percentile("size", 0.5, F.col("groups")).alias("median_size"),
        F.percentile("size", 0.9, F.col("groups")).alias("p90_size"), F.max("size").alias("max_size"))


def group_size_counts(df: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have each size."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def near_copy_summary(nearest: DataFrame, distance: str = "distance", threshold: float = 0.98) -> DataFrame:
    """Largest and median nearest cosine, and how many lie above the copy threshold."""
    cos = F.lit(1.0) - F.col(distance)
    top = nearest.agg(F.max(cos).alias("max_cosine"), F.count_if(cos > threshold).alias("n_copies"))
    mid = exact_quantiles(nearest, cos, [0.5]).select("n", F.col("q0").alias("median_cosine"))
    return top.join(F.broadcast(mid))


def mixed_population(decided: DataFrame, out_of_scope: Column, truth: Column, target: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Known and out-of-scope rows together."""
    ans, top = F.col("answered"), F.col("top")
    called = ans & (top == target)
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(ans).alias("coverage"),
        (F.count_if(ans & (top == truth) & ~out_of_scope) / F.greatest(F.lit(1), F.count_if(ans))).alias("acc_answered"),
        (F.count_if(called & out_of_scope) / F.greatest(F.lit(1), F.count_if(called))).alias("flagged_out_of_scope"))
