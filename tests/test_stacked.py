"""Batched fits, the paired bootstrap and grouped areas against their plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions.numeric import beta_cdf, softmax_rows
from tamis.operators import fitting as FT
from tamis.operators import metrics as M
from tamis.operators import stacked as ST
from tamis.operators.bootstrap import group_bootstrap, paired_bootstrap

CLASSES = ("a", "b", "c", "never")
GRID = (0.01, 0.1, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    y = rng.choice(3, 300, p=[0.6, 0.3, 0.1])
    e = rng.normal(size=(3, 6))[y] + 1.2 * rng.normal(size=(300, 6))
    fold = [None if i % 5 == 0 else i % 3 for i in range(300)]
    table = spark.createDataFrame([(i, [float(x) for x in r], int(c), f) for i, (r, c, f) in enumerate(zip(e, y, fold))],
                                  "item_id bigint, e array<double>, class_idx int, fold int").repartition(5)
    return table, e, y, np.array([-1 if f is None else f for f in fold])


def test_equal_to_one_fit_after_the_other(rows):
    table = rows[0]
    got = ST.fit_heads(table, GRID, CLASSES, [0, 1, 2, None])
    for c in GRID:
        for f in (0, None):
            train = table if f is None else table.where(f"fold is null or fold <> {f}")
            one = FT.fit_head(train, c, CLASSES, tol=1e-14)
            np.testing.assert_allclose(got[c][f].weights, one.weights, atol=1e-6)
            np.testing.assert_allclose(got[c][f].bias, one.bias, atol=1e-6)


def test_every_head_is_at_its_minimum(rows):
    table, e, y, fold = rows
    got = ST.fit_heads(table, GRID, CLASSES, [0, 1, 2], other_weight=2.0)
    for c in GRID:
        for f in (0, 1, 2):
            h, at = got[c][f], fold != f
            w = at.sum() / (3 * np.bincount(y[at]))
            w[2] *= 2.0
            p = softmax_rows(e[at] @ h.weights[:3].T + h.bias[:3])
            p[np.arange(at.sum()), y[at]] -= 1
            p *= w[y[at]][:, None]
            assert np.abs(p.T @ e[at] + h.weights[:3] / c).max() < 1e-4 and np.abs(p.sum(axis=0)).max() < 1e-4
            assert not h.weights[3].any() and h.bias[3] == 0


def test_one_job_a_step_for_all_heads(rows, monkeypatch):
    """The steps of nine heads take about as many jobs as those of the slowest path, and the path starts warm."""
    jobs = []
    evaluate = ST._Stack.evaluate

    def counted(self, folds, weights, points):
        jobs.append(len(folds))
        return evaluate(self, folds, weights, points)

    monkeypatch.setattr(ST._Stack, "evaluate", counted)
    ST.fit_heads(rows[0], GRID, CLASSES, [0, 1, 2])
    together, steps = len(jobs), sum(jobs)
    jobs.clear()
    for c in GRID:
        ST.fit_heads(rows[0], [c], CLASSES, [0])
    assert together <= len(jobs) and steps > 4 * together


def test_chosen_strength(rows):
    table, e, y, fold = rows
    pool = table.where("fold is not null")
    got = {r.c: (r.nll, r.chosen) for r in ST.select_c(pool, GRID, CLASSES).collect()}
    at = fold >= 0
    for c in GRID:
        loss = 0.0
        for f in (0, 1, 2):
            h = FT.fit_head(pool.where(F.col("fold") != f), c, CLASSES, tol=1e-13)
            p = softmax_rows(e[fold == f] @ h.weights.T + h.bias)
            loss -= np.log(p[np.arange((fold == f).sum()), y[fold == f]]).sum()
        assert abs(got[c][0] - loss / at.sum()) < 1e-6
    assert [c for c in GRID if got[c][1]] == [min(GRID, key=lambda c: got[c][0])]


def test_no_rows(rows):
    with pytest.raises(ValueError, match="no training rows"):
        ST.fit_heads(rows[0].limit(0), [1.0], CLASSES, [0])


def test_equal_heads_differ_by_nothing(spark):
    base = spark.range(600).select((F.col("id") % 90).alias("g"), (F.col("id") % 5 < 2).alias("hit"), (F.col("id") % 3 == 0).alias("base"))
    both = base.withColumn("model", F.explode(F.array(F.lit("x"), F.lit("y"))))
    measures = {"m": (F.col("hit"), F.lit(True)), "of_base": (F.col("hit"), F.col("base")), "none": (F.col("hit"), F.lit(False))}
    got = {r.measure: r for r in paired_bootstrap(both, "model", ("x", "y"), "g", measures, reps=200).collect()}
    for m in ("m", "of_base"):
        assert (got[m].difference, got[m].low, got[m].high) == (0.0, 0.0, 0.0)
    assert got["none"].difference is None
    one = {r.measure: r.value for r in group_bootstrap(base, "g", measures, reps=5).collect()}
    assert got["m"]["first"] == one["m"] and got["of_base"]["second"] == one["of_base"]


def test_paired_interval_is_tighter_than_the_parts(spark):
    """The second model is right where the first is, and on a fixed share more: the difference hardly varies."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("g"), (F.pmod(F.xxhash64(F.floor(F.col("id") / 10)), F.lit(100)) < 50).alias("hard"), "id")
    both = rows.withColumn("model", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("hit", ~F.col("hard") | ((F.col("model") == "y") & (F.col("id") % 10 == 0)))
    measures = {"m": (F.col("hit"), F.lit(True))}
    r = paired_bootstrap(both, "model", ("x", "y"), "g", measures, reps=400).first()
    alone = group_bootstrap(both.where("model = 'x'"), "g", measures, reps=400).first()
    assert r.low <= r.difference <= r.high and r.difference == pytest.approx(r.second - r["first"])
    assert r.high - r.low < alone.high - alone.low


def test_area_by_group(spark):
    rows = [(g, float((7 * i) % 11) if i % 13 else None, i % 3 == 0) for g in (None, 0, 1, 2) for i in range(60 + 10 * (g or 0))] + [(9, 1.0, True), (9, 2.0, True)]
    table = spark.createDataFrame(rows, "g int, s double, y boolean")
    got = {r.g: r for r in M.auroc(table, "s", F.col("y"), by=["g"]).collect()}
    for g in (None, 0, 1, 2):
        one = M.auroc(table.where(F.col("g").eqNullSafe(F.lit(g))), "s", F.col("y")).first()
        assert (got[g].n_pos, got[g].n_neg) == (one.n_pos, one.n_neg) and got[g].auroc == pytest.approx(one.auroc)
    assert got[9].auroc is None


def test_beta_without_warnings():
    with np.errstate(all="raise"):
        got = beta_cdf(np.array([0.0, 1e-200, 0.5, 1.0]), np.array([2.0, 0.02, 3.0, 4.0]), np.array([5.0, 1.0, 3.0, 4.0]))
    assert got[0] == 0 and got[3] == 1 and abs(got[2] - 0.5) < 1e-12 and abs(got[1] - 1e-4) < 1e-8
