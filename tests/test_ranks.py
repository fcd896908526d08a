import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import metrics as M
from tamis.operators.ranks import exact_quantiles, global_rank, hash_order, hash_rank, ordered_prefix
from tamis.operators.shrinkage import rank_groups


@pytest.mark.parametrize("n", [1, 2, 5, 300, 40_000])
@pytest.mark.parametrize("heavy", [False, True])
def test_exact_quantiles(spark, n, heavy):
    x = np.random.default_rng(n).normal(size=n)
    if heavy:
        x[: n // 3] = 0.25
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "g int, v double")
    probs = [0.0, 0.025, 0.5, 0.95, 1.0]
    row = exact_quantiles(df, F.col("v"), probs).first()
    np.testing.assert_allclose([row[f"q{i}"] for i in range(5)], np.quantile(x, probs), atol=1e-12)
    for row in exact_quantiles(df, F.col("v"), probs, ["g"]).collect():
        part = x[row.g::2]
        assert row.n == len(part)
        np.testing.assert_allclose([row[f"q{i}"] for i in range(5)], np.quantile(part, probs), atol=1e-12)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = exact_quantiles(df, F.col("v"), [0.5]).first()
    assert (row.n, row.q0) == (2, 2.0)


@pytest.mark.parametrize("heavy", [False, True])
def test_ordered_prefix(spark, heavy):
    rng = np.random.default_rng(4)
    n = 5000
    v, c = np.round(rng.random(n), 3), rng.integers(0, 2, n)
    if heavy:
        v[: n // 3] = 0.5
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, c))], "id bigint, v double, c int")
    got = sorted((r.rank, r.id, r.hits) for r in ordered_prefix(df, "v", "id", {"hits": F.col("c")}).collect())
    order = np.lexsort((np.arange(n), -v))
    want = [(k + 1, int(i), int(h)) for k, (i, h) in enumerate(zip(order, np.cumsum(c[order])))]
    assert got == want


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7))
    got = hash_rank(df, hash_order("s", F.col("id")), ["k"], "id", "rn", "t")
    per = got.groupBy("k").agg(F.count_distinct("rn").alias("d"), F.max("rn").alias("m"), F.max("t").alias("t"), F.count("*").alias("n"))
    assert all(r.d == r.m == r.t == r.n for r in per.collect())


def test_auroc_with_ties(spark):
    rng = np.random.default_rng(9)
    s, y = np.round(rng.random(400), 1), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.auroc(df, "s", F.col("y")).first().auroc == pytest.approx(want, abs=1e-12)


def test_weights_sum_to_groups(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 9))
    total = M.group_weights(df, "g").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(df.select("g").distinct().count())


def test_calibration_error_ignores_zero_confidence(spark):
    df = spark.createDataFrame([(0.0, True), (0.95, True), (0.85, False), (0.30000000000000004, True)], "max_prob double, ok boolean")
    assert M.ece(df, F.col("ok")).first().ece == pytest.approx((0.05 + 0.85 + 0.7) / 4)


def test_ties_keep_their_own_type(spark):
    """Text ids, and numbers beyond 2^53, order ties as they are."""
    for ids, kind in ((["b10", "b9", "a", None], "string"), ([2**53 + 1, 2**53, 2**53 + 2, 5], "bigint")):
        df = spark.createDataFrame([(i, 0.5) for i in ids], f"id {kind}, v double")
        got = [r.id for r in ordered_prefix(df, "v", "id", {"n": F.lit(1)}).orderBy("rank").collect()]
        assert got == sorted(ids, key=lambda x: (x is not None, x))


def test_a_third_of_the_groups_at_zero(spark):
    """Groups that share one posterior are ranked in several parts, by their answers and keys."""
    rows = spark.range(30_000).select(F.col("id").alias("g"), (F.col("id") % 5).alias("n"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).when(
        F.col("id") % 3 == 1, F.col("id") / 30_000).alias("p_above"))
    got = rank_groups(rows, "g")
    assert [(r.g, r.rank) for r in got.orderBy("rank").limit(2).collect()] == [(29_998, 1), (29_995, 2)]
    want = rows.toPandas().assign(p=lambda d: -d.p_above.fillna(-1), m=lambda d: -d.n).sort_values(["p", "m", "g"]).g.tolist()
    assert [r.g for r in got.orderBy("rank").collect()] == want
    assert global_rank(rows.limit(0), [F.col("g")]).count() == 0
