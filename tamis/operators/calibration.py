"""Scalars of the decision rule, and the choice between candidate rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.numeric import matrix
from tamis.operators.metrics import share
from tamis.operators.ranks import exact_quantiles, join_on, quantile

THRESHOLDS = [0.3 + i * 0.69 / 69 for i in range(70)]
TARGET_ACCURACY = 0.90
MIN_ANSWERED = 20
FAMILIAR_SHARE = 0.95
TEMPERATURE_RANGE = (0.05, 20.0)


def temperature_grid(low: float, high: float, points: int = 200) -> list[float]:
    return [math.exp(math.log(low) + i * (math.log(high) - math.log(low)) / (points - 1)) for i in range(points)]


def nll_curve(scored: DataFrame, truth: str, temperatures: Sequence[float], logits: str = "logits",
              by: Sequence[str] = ()) -> DataFrame:
    """(by..., t_idx, t, n, nll): mean negative log likelihood at every temperature. Each batch sends one sum per
    temperature, so rows are never multiplied by the grid."""
    grid = np.asarray(temperatures, dtype=np.float64)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")

    def partial(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            z = matrix(b.column(1))
            y = np.asarray(b.column(2).to_numpy(zero_copy_only=False)).astype(int)
            kinds, at = np.unique(np.array(b.column(0).to_pylist(), dtype=object), return_inverse=True)
            gap = z - z[np.arange(len(y)), y][:, None]
            peak = gap.max(axis=1)
            sums = np.empty((len(grid), len(kinds)))
            for i, t in enumerate(grid):
                loss = peak / t + np.log(np.exp((gap - peak[:, None]) / t).sum(axis=1))
                sums[i] = np.bincount(at, weights=loss, minlength=len(kinds))
            ti, ki = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds[ki.ravel()].tolist(), pa.string()), pa.array(ti.ravel().astype(np.int32)),
                 pa.array(np.bincount(at, minlength=len(kinds))[ki.ravel()].astype(np.int64)), pa.array(sums.ravel())],
                names=["k", "t_idx", "n", "s"])

    parts = scored.select(key.alias("k"), logits, F.col(truth).cast("int")).mapInArrow(
        partial, "k string, t_idx int, n bigint, s double")
    total = parts.groupBy("k", "t_idx").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    names = [F.get(F.split("k", r"\|"), F.lit(i)).alias(c) for i, c in enumerate(by)]
    return total.select(*names, "t_idx", F.get(F.array(*[F.lit(float(t)) for t in grid]), F.col("t_idx")).alias("t"),
                        "n", (F.col("s") / F.col("n")).alias("nll"))


def fit_temperature(scored: DataFrame, truth: str, logits: str = "logits") -> float:
    """Minimum of the mean loss on a log grid, refined twice around the best point."""
    low, high = TEMPERATURE_RANGE
    for _ in range(3):
        grid = temperature_grid(low, high)
        best = nll_curve(scored, truth, grid, logits).agg(
            F.min_by("t_idx", F.struct("nll", "t_idx"))).first()[0]
        low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    return math.sqrt(low * high)


def familiarity_cutoff(scored: DataFrame, p: float = FAMILIAR_SHARE, distance: str = "distance") -> float | None:
    return quantile(scored, F.col(distance), p)


def threshold_curve(decided: DataFrame, truth: str, thresholds: Sequence[float] = THRESHOLDS,
                    by: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """(by..., t_idx, t, answered, correct) for every threshold: each row is counted once, in the bin of the largest
    threshold it passes, and the bins are summed from the top."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    usable = F.col("familiar") & ~F.col("routed")
    rows = decided.where(usable if mask is None else usable & mask)
    passed = F.size(F.filter(grid, lambda t: t <= F.col("max_prob"))) - 1
    bins = rows.groupBy(*by, passed.alias("_b")).agg(F.count(F.lit(1)).alias("_n"),
                                                    F.count_if(F.col("top") == F.col(truth)).alias("_k"))
    # at most one row per grid point: every bin counts for the thresholds up to its own
    spread = bins.where("_b >= 0").withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    return spread.groupBy(*by, "t_idx").agg(F.sum("_n").alias("answered"), F.sum("_k").alias("correct")).select(
        *by, "t_idx", F.get(grid, F.col("t_idx")).alias("t"), "answered", "correct")


def select_threshold(decided: DataFrame, truth: str, target: float = TARGET_ACCURACY, least: int = MIN_ANSWERED,
                     by: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """(by..., threshold): the smallest grid point with enough answers and accuracy, 0.0 when none passes."""
    curve = threshold_curve(decided, truth, by=by, mask=mask)
    ok = (F.col("answered") >= least) & (F.col("correct") / F.col("answered") >= target)
    found = curve.groupBy(*by).agg(F.coalesce(F.min(F.when(ok, F.col("t"))), F.lit(0.0)).alias("threshold"))
    if not by:
        return found
    # a key without a usable row has no curve and takes 0.0 as well
    every = decided.groupBy(*by).agg(F.lit(0.0).alias("_least"))
    return join_on(every, found, by, "left").select(*by, F.coalesce("threshold", "_least").alias("threshold"))


def other_margin(logits: Column, other: int) -> Column:
    """Score of the class that is routed away minus the best of the others."""
    rest = F.filter(F.transform(logits, lambda x, i: F.when(i == other, F.lit(None).cast("double")).otherwise(x)),
                    lambda x: x.isNotNull())
    return F.get(logits, F.lit(other)) - F.array_max(rest)


def other_bias(scored: DataFrame, other: int, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """Constant for the routed class so that it is on top for the share `budget` of these rows."""
    q = exact_quantiles(scored, other_margin(F.col("logits"), other), [1.0 - budget], by)
    return q.select(*by, (-F.col("q0")).alias("other_bias"))


def parameter_counts(scored: DataFrame, grid: Sequence[float], hit: Column, value: Column) -> DataFrame:
    """Every row under every candidate: rows with value <= candidate, and hits among them. The candidates are literals
    expanded and counted inside each task before anything is shuffled."""
    wanted = F.array(*[F.lit(float(g)) for g in grid])
    rows = scored.select(value.alias("_v"), hit.alias("_h"), F.posexplode(wanted).alias("candidate_idx", "candidate"))
    return rows.groupBy("candidate_idx", "candidate").agg(
        F.count_if(F.col("_v") <= F.col("candidate")).alias("passed"),
        F.count_if((F.col("_v") <= F.col("candidate")) & F.col("_h")).alias("hits"))


def rule_ablation(rows: DataFrame, candidates: Sequence[float], local: str, current: Column, extra: Column, right: Column,
                  by: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """What a second cutoff adds to the current rule: (by..., candidate, added_share, added_accuracy). `current`: answered
    now; `extra`: would be answered if familiar. Weights are 1 / group size within `by`."""
    wanted = F.array(*[F.lit(float(c)) for c in candidates])
    keys = [*by, *([group] if group else [])]
    added = ~current & extra & F.col(local).isNotNull()
    level = F.size(F.filter(wanted, lambda c: c < F.col(local)))  # candidates are given in increasing order
    per = rows.groupBy(*keys, F.when(added, level).alias("_l")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(added & right).alias("_k"))
    sized = per.groupBy(*keys).agg(F.sum("_n").alias("_t"), F.collect_list(
        F.when(F.col("_l").isNotNull(), F.struct("_l", "_n", "_k"))).alias("_a"))  # at most one entry per candidate
    w = 1.0 / F.col("_t") if group else F.lit(1.0)
    base = sized.groupBy(*by).agg(F.sum(F.col("_t") * w).alias("_base"))
    gain = (sized.select(*by, w.alias("_w"), F.explode("_a").alias("_e"))
            .where(F.col("_e._l") < len(candidates))
            .groupBy(*by, F.col("_e._l").alias("_l")).agg(F.sum(F.col("_w") * F.col("_e._n")).alias("_wn"),
                                                          F.sum(F.col("_w") * F.col("_e._k")).alias("_wk")))
    # one row per candidate and key: every level counts for its own candidate and all larger ones
    cand = base.select(*by, "_base", F.posexplode(wanted).alias("_c", "candidate"))
    cond = [cand[c].eqNullSafe(gain[c]) for c in by] + [gain["_l"] <= cand["_c"]]
    total = cand.join(gain, cond, "left").groupBy(*[cand[c] for c in by], "candidate").agg(
        F.max("_base").alias("_base"), F.coalesce(F.sum("_wn"), F.lit(0.0)).alias("_wn"), F.sum("_wk").alias("_wk"))
    return total.select(*by, "candidate", (F.col("_wn") / F.col("_base")).alias("added_share"),
                        (F.col("_wk") / F.nullif(F.col("_wn"), F.lit(0.0))).alias("added_accuracy"))


def select_candidate(ablation: DataFrame, floor: float, candidate: str = "candidate", accuracy: str = "added_accuracy") -> DataFrame:
    """The largest candidate whose added rows reach the floor everywhere; an empty cell passes; null means reject."""
    ok = ablation.groupBy(candidate).agg(F.bool_and(F.col(accuracy).isNull() | (F.col(accuracy) >= floor)).alias("_ok"))
    return ok.agg(F.max(F.when(F.col("_ok"), F.col(candidate))).alias("selected"))


def decision_gates(current: DataFrame, proposed: DataFrame, on: str, limits: dict[str, float]) -> DataFrame:
    """(measure, worst_drop, limit, passed) per gate, and an 'all gates' row with the decision."""
    both = current.alias("c").join(proposed.alias("p"), on)
    gates = None
    for m, limit in limits.items():
        drop = F.col(f"p.{m}") - F.col(f"c.{m}")
        row = both.agg(F.lit(m).alias("gate"), F.min(drop).alias("worst_change"), F.lit(float(limit)).alias("limit"),
                       F.coalesce(F.bool_and(F.coalesce(-drop <= limit, F.lit(False))), F.lit(False)).alias("passed"))
        gates = row if gates is None else gates.unionByName(row)
    final = gates.agg(F.lit("all gates").alias("gate"), F.lit(None).cast("double").alias("worst_change"),
                      F.lit(None).cast("double").alias("limit"), F.bool_and("passed").alias("passed"))
    return gates.unionByName(final)


def apply_fold_scalars(rows: DataFrame, scalars: DataFrame, final: dict[str, float], fold: str = "fold") -> DataFrame:
    """Each row with the scalars of its own fold, rows without one with the final scalars. One scalar row per fold."""
    names = list(final)
    s = scalars.select(F.col(fold).alias("_f"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = rows.join(F.broadcast(s), rows[fold] == s["_f"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_{n}"), F.lit(float(v))).alias(n) for n, v in final.items()])


def paired_folds(first: DataFrame, second: DataFrame, measures: Sequence[str], fold: str = "fold") -> DataFrame:
    """(measure, mean_difference, folds_lower) of two runs on the same folds."""
    both = first.alias("a").join(second.alias("b"), fold)
    out = None
    for m in measures:
        d = F.col(f"b.{m}") - F.col(f"a.{m}")
        row = both.agg(F.lit(m).alias("measure"), F.avg(d).alias("mean_difference"), F.count_if(d < 0).alias("folds_lower"))
        out = row if out is None else out.unionByName(row)
    return out


def accuracy_by_reason(decided: DataFrame, truth: str) -> DataFrame:
    return decided.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), share(F.col("top") == F.col(truth)).alias("accuracy"))
