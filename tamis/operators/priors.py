"""Beta-binomial priors without a grid, for any number of keys in one job, and the backtest of the alert rule they serve.

The likelihood needs only how often each x, each n - x and each n occurs. The rows of a key are counted by these values before anything
is shuffled; n adds up to at most the rows behind the groups, so a key with R answers has no more than sqrt(2 R) values of a kind,
and a fit is one small task however many groups a key has."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import digamma, lgamma, trigamma
from tamis.operators.shrinkage import (
    ALERT_PROBABILITY,
    ALERT_RATE,
    LOG_ALPHA,
    LOG_BETA,
    PRIOR_CAP,
    alert_backtest,
    share_above,
)

MOST_STRENGTH = 1e6  # beyond it the groups don't differ: the prior is a point
_STEPS = 200
_SOLVED = 1e-9  # mean gradient per group

Counts = tuple[tuple[np.ndarray, np.ndarray], ...]  # (values, times) of x, n - x, n


def log_likelihood(counts: Counts, a: float, b: float) -> float:
    """Log likelihood of the counted groups, less the part that the prior doesn't change."""
    return float(sum(sign * (times * (lgamma(values + p) - lgamma(np.array(p)))).sum()
                     for (values, times), p, sign in zip(counts, (a, b, a + b), (1, 1, -1), strict=True)))


def _slopes(counts: Counts, mean: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood by logit(mean) and ln(size) of Beta(size mean, size (1 - mean))."""
    a, b = size * mean, size * (1 - mean)
    (ga, ha), (gb, hb), (gn, hn) = (
        (float((t * (digamma(v + p) - digamma(np.array(p)))).sum()), float((t * (trigamma(v + p) - trigamma(np.array(p)))).sum()))
        for (v, t), p in zip(counts, (a, b, a + b), strict=True))
    ga, gb, haa, hbb, hab = ga - gn, gb - gn, ha - hn, hb - hn, -hn
    turn = np.array([[size * mean * (1 - mean), a], [-size * mean * (1 - mean), b]])  # d(a, b) / d(logit, ln size)
    slope = turn.T @ np.array([ga, gb])
    bend = turn.T @ np.array([[haa, hab], [hab, hbb]]) @ turn
    q = turn[0, 0] * (ga - gb)
    return slope, bend + np.array([[(1 - 2 * mean) * q, q], [q, slope[1]]])


def newton_prior(counts: Counts) -> tuple[float, float, float]:
    """(alpha, beta, largest mean gradient) of the maximum likelihood by Newton steps in logit(mean) and ln(size).

    Starts at the best of a few sizes at the pooled mean. Where the likelihood grows with the size without end, the size is
    MOST_STRENGTH and the mean is the best one there; its gradient by the size is then left out."""
    groups = counts[2][1].sum()
    mean = (counts[0][0] * counts[0][1]).sum() / (counts[2][0] * counts[2][1]).sum()
    top = np.log(MOST_STRENGTH)

    def pair(at: np.ndarray) -> tuple[float, float]:
        m = 1 / (1 + np.exp(-at[0]))
        return float(np.exp(at[1]) * m), float(np.exp(at[1]) / (1 + np.exp(at[0])))

    def value(at: np.ndarray) -> float:
        return log_likelihood(counts, *pair(at))

    centre = np.log(np.clip(mean, 1e-3, 1 - 1e-3) / (1 - np.clip(mean, 1e-3, 1 - 1e-3)))
    starts = [np.array([centre + shift, s]) for shift in (-1.0, 0.0, 1.0) for s in np.arange(-4.0, top, 1.5)]
    at = max(starts, key=value)
    best, left = value(at), np.inf
    for _ in range(_STEPS):
        slope, bend = _slopes(counts, 1 / (1 + np.exp(-at[0])), float(np.exp(at[1])))
        free = np.array([True, not (at[1] >= top and slope[1] > 0)])
        left = float(np.abs(slope[free]).max() / groups)
        if left < _SOLVED:
            break
        g, h = slope[free], bend[np.ix_(free, free)]
        rise = np.linalg.eigvalsh(h).max()
        if rise > -1e-12 * groups:  # not a hill here: tilt it until it is one
            h = h - (rise + 1e-3 * np.abs(h).max() + 1e-9) * np.eye(len(g))
        step = np.zeros(2)
        step[free] = np.clip(-np.linalg.solve(h, g), -2.0, 2.0)
        for _half in range(40):
            to = np.array([np.clip(at[0] + step[0], -30, 30), np.clip(at[1] + step[1], -30, top)])
            new = value(to)
            if new >= best - 1e-13 * abs(best):
                break
            step /= 2
        else:
            break
        if np.array_equal(to, at):
            break
        at, best = to, new
    return *pair(at), left


def grid_prior(counts: Counts) -> tuple[float, float, float]:
    """The best grid point as in `shrinkage`, the first on ties to 9 places."""
    a, b = np.exp(np.array(LOG_ALPHA)), np.exp(np.array(LOG_BETA))
    both = (a[:, None] + b[None, :]).ravel()
    up, down, joint = (
        sum((times[lo:lo + 64, None] * (lgamma(values[lo:lo + 64, None] + p) - lgamma(p))).sum(axis=0) for lo in range(0, len(values), 64))
        for (values, times), p in zip(counts, (a, b, both), strict=True))
    total = np.round(up[:, None] + down[None, :] - joint.reshape(len(a), len(b)), 9)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    return float(a[i]), float(b[j]), float("nan")


def value_counts(groups: DataFrame, by: Sequence[str], flagged: str, answered: str) -> DataFrame:
    """(by, kind, v, c): how often x (0), n - x (1) and n (2) take each value in groups with answers."""
    x, n = F.col(flagged).cast("double"), F.col(answered).cast("double")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), v.alias("v")) for i, v in enumerate((x, n - x, n))])
    return groups.where((n > 0) & x.isNotNull()).select(*by, F.explode(kinds).alias("_k")).groupBy(
        *by, F.col("_k.kind").alias("kind"), F.col("_k.v").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))


def fitted_priors(groups: DataFrame, by: Sequence[str], flagged: str = "x", answered: str = "n", cap: float | None = PRIOR_CAP,
                  grid: bool = False) -> DataFrame:
    """One row per key: alpha, beta, strength (alpha + beta before the cap), capped, groups (those with answers), gradient (largest
    mean gradient left; null on the grid). Keys without an answered group have no row; there is no fixed prior for few groups.
    With `cap` None the fit stands as it is."""
    fit = grid_prior if grid else newton_prior

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        counts = tuple((f.v[f.kind == k].to_numpy(float), f.c[f.kind == k].to_numpy(float)) for k in range(3))
        a, b, left = fit(counts)
        share = 1.0 if cap is None else min(1.0, cap / (a + b))
        row = [*[f[c].iloc[0] for c in by], a * share, b * share, a + b, share < 1, int(counts[2][1].sum()), None if np.isnan(left) else left]
        return pd.DataFrame([row], columns=[*by, "alpha", "beta", "strength", "capped", "groups", "gradient"])

    types = "".join(f"`{c}` {groups.schema[c].dataType.simpleString()}, " for c in by)
    counted = value_counts(groups, by, flagged, answered).withColumn("_all", F.lit(0))
    return counted.groupBy(*by, "_all").applyInPandas(
        solve, types + "alpha double, beta double, strength double, capped boolean, groups bigint, gradient double")


def posterior_backtest(rounds: DataFrame, truth: str, key: str, by: str = "round", flagged: str = "x", answered: str = "n",
                       rate: float = ALERT_RATE, probability: float = ALERT_PROBABILITY, cap: float | None = PRIOR_CAP,
                       grid: bool = False, places: int | None = None, top: int = 5) -> DataFrame:
    """Per rule (raw, adjusted) and round: false_alarms, missed, top_hits. The raw rule alerts on a share of answers above `rate`; the
    adjusted one on P(share > rate) above `probability` under the prior fitted over the groups of the same round. A group without
    answers has the raw share 0, no raw alert, and the prior as its posterior; rows without a round are left out. `places` rounds the posterior before it is used."""
    n, x = F.coalesce(F.col(answered), F.lit(0)), F.coalesce(F.col(flagged), F.lit(0))
    fitted = fitted_priors(rounds, [by], flagged, answered, cap, grid).select(by, "alpha", "beta")
    posterior: Column = share_above((F.col("alpha") + x).cast("double"), (F.col("beta") + n - x).cast("double"), F.lit(float(rate)))
    scored = rounds.join(fitted, by, "left").withColumn("adjusted", posterior).withColumn("raw", F.when(n > 0, x / n).otherwise(F.lit(0.0)))
    if places is not None:
        scored = scored.withColumn("adjusted", F.round("adjusted", places))
    parts = []
    for rule, line in (("raw", rate), ("adjusted", probability)):
        hit = scored.withColumn("_hit", F.coalesce(F.col(rule) > line, F.lit(False)))
        parts.append(alert_backtest(hit, truth, "_hit", rule, key, by, top).select(F.lit(rule).alias("rule"), "*"))
    return parts[0].unionByName(parts[1])


def mean_backtest(per_round: DataFrame) -> DataFrame:
    """The three counts of each rule, averaged over the rounds."""
    return per_round.groupBy("rule").agg(F.count(F.lit(1)).alias("rounds"), *[F.avg(c).alias(c) for c in ("false_alarms", "missed", "top_hits")])
