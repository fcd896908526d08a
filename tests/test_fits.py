import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions.numeric import beta_cdf, lgamma, softmax_rows
from tamis.operators import calibration as C
from tamis.operators import fitting as FT
from tamis.operators import shrinkage as SH
from tamis.operators.bootstrap import group_bootstrap
from tamis.operators.scoring import Head


def data(n=240, d=6, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.choice(k, n, p=np.array([0.6, 0.3, 0.1][:k]) / sum([0.6, 0.3, 0.1][:k]))
    e = rng.normal(size=(k, d))[y] + 1.2 * rng.normal(size=(n, d))
    return e, y


def frame(spark, e, y):
    return spark.createDataFrame([(i, [float(x) for x in r], int(c)) for i, (r, c) in enumerate(zip(e, y))],
                                 "item_id bigint, e array<double>, class_idx int").repartition(4)


def test_fit_head_is_at_the_minimum(spark):
    e, y = data()
    head = FT.fit_head(frame(spark, e, y), 0.5, ("a", "b", "c"))
    w = len(y) / (3 * np.bincount(y))[y]
    p = softmax_rows(e @ head.weights.T + head.bias)
    p[np.arange(len(y)), y] -= 1
    p *= w[:, None]
    grad = p.T @ e + head.weights / 0.5
    assert np.abs(grad).max() < 1e-3 and np.abs(p.sum(axis=0)).max() < 1e-3


def test_absent_classes_are_zero(spark):
    e, y = data()
    head = FT.fit_head(frame(spark, e, y), 1.0, ("a", "b", "c", "never"))
    assert not head.weights[3].any() and head.bias[3] == 0


def start(k=3, d=6):
    rng = np.random.default_rng(5)
    return Head(tuple("abc"[:k]), rng.normal(size=(k, d)), rng.normal(size=k), temperature=1.7, prior_strength=0.3)


def gradient(head, base, e, y, lam):
    p = softmax_rows((e @ head.weights.T + head.bias) / base.temperature)
    p[np.arange(len(y)), y] -= 1
    p /= base.temperature * len(y)
    return np.r_[(p.T @ e + lam * (head.weights - base.weights)).ravel(), p.sum(axis=0) + lam * (head.bias - base.bias)]


def test_adapt_head_is_at_the_minimum_and_equals_the_local_form(spark):
    e, y = data(seed=2)
    base = start()
    far = FT.adapt_head(base, frame(spark, e, y))
    near = FT.adapt_rows(base, e, y)
    assert np.abs(gradient(far, base, e, y, 0.3)).max() < 1e-6
    assert np.abs(gradient(near, base, e, y, 0.3)).max() < 1e-6
    np.testing.assert_allclose(far.weights, near.weights, atol=1e-5)


def test_adapt_limits(spark):
    e, y = data(seed=3)
    base = start()
    np.testing.assert_allclose(FT.adapt_rows(base, e, y, 1e9).weights, base.weights, atol=1e-6)
    assert FT.adapt_rows(base, e[:0], y[:0]) is base
    assert FT.adapt_head(base, frame(spark, e, y).where("item_id < 0")) is base


def test_local_only_two_classes_split_evenly():
    e, y = data(k=2, seed=4)
    w, b = FT.local_only_rows(("a", "b", "c"), e, y)
    np.testing.assert_allclose(w[0], -w[1])
    assert b[2] == -1e3 and FT.local_only_rows(("a", "b"), e, np.zeros(len(y), int)) is None
    m = np.where(y == 1, 1, -1) * (e @ (2 * w[1]) + 2 * b[1])
    g = -np.where(y == 1, 1, -1) * (len(y) / (2 * np.bincount(y)))[y] / (1 + np.exp(m))
    assert np.abs(e.T @ g + 2 * w[1]).max() < 1e-5


def test_temperature_is_the_minimum(spark):
    rng = np.random.default_rng(6)
    z = 3 * rng.normal(size=(500, 3))
    y = np.array([rng.choice(3, p=p) for p in softmax_rows(z / 2.0)])
    df = spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(z, y)], "logits array<double>, y int")

    def loss(t):
        return float(-np.log(softmax_rows(z / t)[np.arange(500), y]).mean())

    t = C.fit_temperature(df, "y")
    assert loss(t) <= min(loss(t * 1.001), loss(t / 1.001)) + 1e-9


def test_threshold_rules(spark):
    rows = [(0.995, 1, 1)] * 25 + [(0.5, 0, 1)] * 30
    df = spark.createDataFrame([(p, a, b, True, False) for p, a, b in rows], "max_prob double, top int, y int, familiar boolean, routed boolean")
    assert C.select_threshold(df, "y").first().threshold == pytest.approx(min(t for t in C.THRESHOLDS if t > 0.5))
    assert C.select_threshold(df.where("max_prob < 0.6"), "y").first().threshold == 0.0
    assert len(C.THRESHOLDS) == 70 and C.THRESHOLDS[0] == 0.3 and C.THRESHOLDS[-1] == pytest.approx(0.99)


def test_lgamma_and_beta():
    x = np.array([0.01, 0.3, 1.0, 2.5, 9.99, 10.0, 55.5, 4000.0])
    np.testing.assert_allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    for a, b in ((0.5, 0.7), (3, 5), (30, 90), (400, 900)):
        for q in (0.05, 0.25, 0.6):
            t = (np.arange(400_000) + 0.5) / 400_000 * q
            dens = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
            assert beta_cdf(q, np.array([a]), np.array([b]))[0] == pytest.approx(dens.sum() * q / 400_000, abs=2e-3 if a < 1 else 1e-6)
    assert beta_cdf(0.0, np.array([2.0]), np.array([2.0]))[0] == 0 and beta_cdf(1.0, np.array([2.0]), np.array([2.0]))[0] == 1


def test_published_demo_groups(spark):
    groups = [("A", 2, 3), ("B", 30, 80), ("C", 9, 70), ("D", 12, 75), ("E", 8, 60), ("F", 14, 90)]
    df = spark.createDataFrame(groups, "g string, x bigint, n bigint")
    prior = SH.fit_prior(df)
    assert (prior.alpha, prior.beta) == (pytest.approx(5.4739, abs=1e-4), pytest.approx(22.198, abs=1e-3))
    got = {r.g: r for r in SH.posterior_alert(df, prior).collect()}
    for g, adjusted, above in (("A", 0.2437, 0.4393), ("B", 0.3295, 0.9655), ("C", 0.1482, 0.0059), ("D", 0.1702, 0.0228),
                               ("E", 0.1537, 0.0121), ("F", 0.1655, 0.0118)):
        assert got[g].adjusted == pytest.approx(adjusted, abs=1e-4) and got[g].p_above == pytest.approx(above, abs=1e-4)
    assert [g for g in got if got[g].alert] == ["B"]
    lo, hi = sorted((2 / 3, prior.alpha / (prior.alpha + prior.beta)))
    assert lo < got["A"].adjusted < hi


def test_fallback_prior_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1, 4), ("b", 0, 0)], "g string, x bigint, n bigint")
    prior = SH.fit_prior(df)
    assert (prior.alpha, prior.beta, prior.source) == (1.0, 4.0, "fallback")
    empty = [r for r in SH.posterior_alert(df, prior).collect() if r.g == "b"][0]
    assert empty.raw is None and empty.adjusted is None and empty.p_above is None and empty.alert is False


def test_bootstrap_interval(spark):
    df = spark.range(900).select((F.col("id") % 150).alias("g"), (F.col("id") % 5 < 2).alias("hit"))
    measures = {"m": (F.col("hit"), F.lit(True)), "none": (F.col("hit"), F.lit(False))}
    first = {r.measure: r for r in group_bootstrap(df, "g", measures, reps=300).collect()}
    again = {r.measure: r for r in group_bootstrap(df.repartition(7), "g", measures, reps=300).collect()}
    assert first["m"].low <= first["m"].value <= first["m"].high and first == again
    assert first["none"].value is None and first["none"].low is None


def test_bootstrap_blocks_draw_every_group_once_on_average():
    from tamis.operators.bootstrap import _block_draws

    sizes = np.array([10, 0, 25, 7, 58])
    draws = np.array([_block_draws(sizes, b, 4000, 3) for b in range(5)])
    assert (draws.sum(axis=0) == 100).all()
    np.testing.assert_allclose(draws.mean(axis=1), sizes, atol=0.4)
