"""Empirical-Bayes ranking of groups: a beta-binomial prior over all groups, a posterior per group, alerts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from tamis.functions.numeric import beta_cdf, lgamma

LOG_ALPHA = [round(-3 + 0.1 * i, 10) for i in range(91)]
LOG_BETA = [round(-3 + 0.1 * i, 10) for i in range(101)]
PRIOR_CAP = 50.0
FALLBACK = (1.0, 4.0)
MIN_GROUPS = 3
ALERT_RATE = 0.25
ALERT_PROBABILITY = 0.5


@dataclass(frozen=True)
class Prior:
    alpha: float
    beta: float
    source: str
    capped: bool


def likelihood_grid(groups: DataFrame, flagged: str = "x", answered: str = "n") -> DataFrame:
    """(i, j, ll): beta-binomial log likelihood on the grid of ln alpha, ln beta. Groups with equal counts are combined
    first; each batch then sends one sum per grid point."""
    pairs = groups.where(F.col(answered) > 0).groupBy(F.col(flagged).cast("double").alias("x"),
                                                      F.col(answered).cast("double").alias("n")).agg(
        F.count(F.lit(1)).alias("c"))

    def partial(batches):
        a, b = np.exp(np.array(LOG_ALPHA)), np.exp(np.array(LOG_BETA))
        both = a[:, None] + b[None, :]
        norm = lgamma(a)[:, None] + lgamma(b)[None, :] - lgamma(both)
        total, seen = np.zeros(both.shape), False
        for batch in batches:
            x, n, c = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=np.float64) for k in range(3))
            for lo in range(0, len(x), 256):
                xs, ns, cs = x[lo:lo + 256], n[lo:lo + 256], c[lo:lo + 256]
                up = (cs[:, None] * lgamma(xs[:, None] + a[None, :])).sum(axis=0)
                down = (cs[:, None] * lgamma((ns - xs)[:, None] + b[None, :])).sum(axis=0)
                kinds, at = np.unique(ns, return_inverse=True)
                weight = np.bincount(at, weights=cs)
                joint = sum(w * lgamma(both + k) for k, w in zip(kinds, weight, strict=True))
                total += up[:, None] + down[None, :] - joint - cs.sum() * norm
                seen = seen or len(xs) > 0
        if seen:
            i, j = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["i", "j", "ll"])

    parts = pairs.mapInArrow(partial, "i int, j int, ll double")
    return parts.groupBy("i", "j").agg(F.sum("ll").alias("ll"))


def beta_binomial_prior(groups: DataFrame, flagged: str = "x", answered: str = "n") -> DataFrame:
    """One row (alpha, beta, source, capped, groups): the best grid point, the first on ties; a fixed prior below three
    groups; together never worth more than 50 rows."""
    count = groups.agg(F.count_if(F.col(answered) > 0).alias("groups"))
    best = likelihood_grid(groups, flagged, answered).agg(
        F.max_by(F.struct("i", "j"), F.struct(F.round("ll", 9), -F.col("i"), -F.col("j"))).alias("g"))
    alpha, beta = F.exp(F.lit(-3.0) + F.col("g.i") * 0.1), F.exp(F.lit(-3.0) + F.col("g.j") * 0.1)
    scale = F.least(F.lit(1.0), F.lit(PRIOR_CAP) / (alpha + beta))
    few = F.col("groups") < MIN_GROUPS
    # two one-row tables
    return best.join(F.broadcast(count)).select(
        F.when(few, FALLBACK[0]).otherwise(alpha * scale).alias("alpha"),
        F.when(few, FALLBACK[1]).otherwise(beta * scale).alias("beta"),
        F.when(few, "fallback").otherwise("fitted").alias("source"),
        F.coalesce(~few & (alpha + beta > PRIOR_CAP), F.lit(False)).alias("capped"), "groups")


def fit_prior(groups: DataFrame, flagged: str = "x", answered: str = "n") -> Prior:
    row = beta_binomial_prior(groups, flagged, answered).first()
    return Prior(float(row.alpha), float(row.beta), row.source, bool(row.capped))


@arrow_udf(DoubleType())
def share_above(a: pa.Array, b: pa.Array, q: pa.Array) -> pa.Array:
    """P(share > q) under Beta(a, b)."""
    x, y, z = (np.asarray(v.to_numpy(zero_copy_only=False), dtype=np.float64) for v in (a, b, q))
    return pa.array(1.0 - beta_cdf(z, x, y), pa.float64())


def posterior_alert(groups: DataFrame, prior: Prior, flagged: str = "x", answered: str = "n", rate: float = ALERT_RATE,
                    probability: float = ALERT_PROBABILITY) -> DataFrame:
    """Adds raw, adjusted, p_above and alert; a group without answers has nulls and no alert."""
    some = F.col(answered) > 0
    a = F.lit(prior.alpha) + F.col(flagged)
    b = F.lit(prior.beta) + F.col(answered) - F.col(flagged)
    above = share_above(a.cast("double"), b.cast("double"), F.lit(float(rate)))
    out = groups.withColumns({"raw": F.when(some, F.col(flagged) / F.col(answered)), "adjusted": F.when(some, a / (a + b)),
                              "p_above": above})
    out = out.withColumn("p_above", F.when(some, F.col("p_above")))
    return out.withColumn("alert", F.coalesce(F.col("p_above") > probability, F.lit(False)))


def rank_groups(scored: DataFrame, key: str, answered: str = "n") -> DataFrame:
    """Adds rank: largest posterior (to 12 places) first, groups without answers last, then more answers, then the key."""
    from tamis.operators.ranks import global_rank

    posterior = F.round(F.coalesce("p_above", F.lit(-1.0)), 12)
    return global_rank(scored, [posterior.desc(), F.col(answered).desc(), F.col(key).asc()])


def shortlist(scored: DataFrame, score: str, key: str, size: int = 5) -> DataFrame:
    """The visit list: the largest scores, at most `size` rows."""
    return scored.orderBy(F.desc_nulls_last(score), key).limit(size)


def alert_backtest(rounds: DataFrame, truth: str, alert: str, score: str, key: str, by: str = "round", top: int = 5) -> DataFrame:
    """Per round: false alarms, missed, and true groups among the `top` scores."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), key)
    counts = rounds.groupBy(by).agg(F.count_if(F.col(alert) & ~F.col(truth)).alias("false_alarms"),
                                    F.count_if(~F.col(alert) & F.col(truth)).alias("missed"))
    hits = (rounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
            .groupBy(by).agg(F.count_if(truth).alias("top_hits")))
    return counts.join(hits, by)
