"""Priors by Newton steps: optimal, never below the grid, whole for lopsided data; the backtest against a plain loop."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tamis.functions.numeric import beta_cdf, digamma, lgamma, trigamma
from tamis.operators import priors as P


def counts_of(x, n):
    return tuple(tuple(v.astype(float) for v in np.unique(k, return_counts=True)) for k in (x, n - x, n))


def drawn(seed, a, b, groups=60, most=40):
    r = np.random.default_rng(seed)
    n = r.integers(1, most, groups)
    return r.binomial(n, r.beta(a, b, groups)), n


def test_gamma_slopes():
    x = np.array([1e-4, 0.3, 1.0, 2.5, 9.9, 30.0, 1e5])
    for f, d in ((lgamma, digamma), (digamma, trigamma)):
        h = 1e-5 * x
        assert np.allclose((f(x + h) - f(x - h)) / (2 * h), d(x), rtol=1e-5)
    assert abs(digamma(np.array(1.0)) + 0.57721566490153286) < 1e-13 and abs(trigamma(np.array(1.0)) - math.pi ** 2 / 6) < 1e-12


@pytest.mark.parametrize("seed,a,b", [(0, 2, 6), (1, 0.3, 0.4), (2, 40, 90), (3, 1, 20), (4, 300, 300), (5, 0.05, 3)])
def test_optimum_and_grid(seed, a, b):
    counts = counts_of(*drawn(seed, a, b))
    alpha, beta, left = P.newton_prior(counts)
    assert left < 1e-8
    assert P.log_likelihood(counts, alpha, beta) >= P.log_likelihood(counts, *P.grid_prior(counts)[:2]) - 1e-9


@pytest.mark.parametrize("x,n", [([0, 0, 0], [5, 9, 1]), ([5, 9, 1], [5, 9, 1]), ([1, 2, 4], [2, 4, 8]), ([3], [7])])
def test_lopsided(x, n):
    counts = counts_of(np.array(x), np.array(n))
    alpha, beta, left = P.newton_prior(counts)
    assert np.isfinite([alpha, beta, left]).all() and alpha > 0 and beta > 0
    assert P.log_likelihood(counts, alpha, beta) >= P.log_likelihood(counts, *P.grid_prior(counts)[:2]) - 1e-6
    assert abs(alpha / (alpha + beta) - sum(x) / sum(n)) < 1e-3


def test_keys_in_one_job(spark):
    rows = [(k, int(x), int(n)) for k, (a, b) in enumerate([(2, 6), (1, 20)]) for x, n in zip(*drawn(k, a, b), strict=True)]
    rows += [(7, 0, 0), (None, 3, 9), (None, 1, 8), (0, None, 4)]
    got = {r.round: r for r in P.fitted_priors(spark.createDataFrame(rows, "round int, x bigint, n bigint"), ["round"], cap=None).collect()}
    assert set(got) == {0, 1, None}
    for k, (a, b) in enumerate([(2, 6), (1, 20)]):
        alpha, beta, _ = P.newton_prior(counts_of(*drawn(k, a, b)))
        assert (got[k].alpha, got[k].beta) == pytest.approx((alpha, beta)) and got[k].gradient < 1e-8 and got[k].groups == 60
    empty = spark.createDataFrame([], "round int, x bigint, n bigint")
    assert P.fitted_priors(empty, ["round"]).collect() == [] and P.fitted_priors(empty, []).collect() == []


def test_backtest(spark):
    rows = []
    for k in range(3):
        x, n = drawn(k, 2, 7, groups=25)
        truth = np.random.default_rng(k + 50).random(25) < 0.3
        rows += [(k, g, int(x[g]), int(n[g]), bool(truth[g])) for g in range(25)]
        rows.append((k, 99, 0, 0, True))
    df = spark.createDataFrame(rows, "round int, grp int, x bigint, n bigint, truth boolean")
    expected = {}
    for k in range(3):
        mine = [r for r in rows if r[0] == k]
        some = [r for r in mine if r[3]]
        a, b, _ = P.newton_prior(counts_of(np.array([r[2] for r in some]), np.array([r[3] for r in some])))
        share = min(1, 50 / (a + b))
        scores = {"raw": [r[2] / r[3] if r[3] else 0.0 for r in mine],
                  "adjusted": [float(1 - beta_cdf(0.25, np.array([a * share + r[2]]), np.array([b * share + r[3] - r[2]]))[0]) for r in mine]}
        for rule, line in (("raw", 0.25), ("adjusted", 0.5)):
            s = scores[rule]
            top = sorted(range(len(mine)), key=lambda i: (-s[i], mine[i][1]))[:5]
            expected[rule, k] = (sum(v > line and not r[4] for v, r in zip(s, mine, strict=True)),
                                 sum(v <= line and r[4] for v, r in zip(s, mine, strict=True)), sum(mine[i][4] for i in top))
    per = P.posterior_backtest(df, "truth", "grp")
    assert {(r.rule, r.round): (r.false_alarms, r.missed, r.top_hits) for r in per.collect()} == expected
    mean = {r.rule: r for r in P.mean_backtest(per).collect()}
    assert mean["raw"].rounds == 3 and mean["adjusted"].missed == pytest.approx(sum(expected["adjusted", k][1] for k in range(3)) / 3)
