"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import hardneg
from tamis.llm.lanes import pack
from tamis.llm.toplists import NONE, TopLists


def brute(rows, is_anchor, positives=5, negatives=10):
    """rows: distinct (id, label, vector of whole numbers)."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i, label, x in rows:
        if not is_anchor(i):
            continue
        others = sorted((-score(x, y), j, m) for j, m, y in rows if j != i)
        for s, j, m in [o for o in others if o[2] == label][:positives]:
            inside = [(t, k) for t, k, n in others if n != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(inside)]
    return sorted(out)


def whole(rows):
    return sorted({(i, m, tuple(int(np.floor(256 * v)) for v in x)) for i, m, x in rows
                   if i is not None and m is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)})


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, label int, embedding array<double>, score int").repartition(3)
    vectors = hardneg.whole_vectors(table, F.col("vec_id"), F.col("embedding"), F.col("label"))
    return hardneg.hard_negatives(vectors, vectors.where("id % 10 = 0"), **sizes)


SMALL = {"shard_rows": 30, "block_anchors": 7, "lanes": 3}


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_hard_negatives(spark, sizes, spread):
    """Clustered and spread vectors; a third of the rows has one label; ties from coarse components."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 12))
    rows = []
    for i in range(400):
        x = np.round(centres[i % 6] + spread * draw.normal(size=12), 1)
        rows.append((i, 0 if i % 3 == 0 else int(draw.integers(1, 9)), [float(v) for v in x]))
    got = sorted(map(tuple, mined(spark, rows, **sizes).collect()))
    assert got == brute(whole(rows), lambda i: i % 10 == 0) and len(got) > 500


def test_large_components(spark):
    """Products beyond 2^53 are scored as 64-bit integers."""
    draw = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in draw.integers(-(1 << 18), 1 << 18, 8)]) for i in range(60)]
    rows += [(100, 0, [float(1 << 20)] * 8), (101, 0, [float((1 << 20) - 1)] * 8), (102, 1, [float(1 << 19)] * 8)]
    assert sorted(map(tuple, mined(spark, rows, **SMALL).collect())) == brute(whole(rows), lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.1]), (1, 1, [0.9, 0.1]), (2, 2, [0.5]), (3, 2, [0.4, 0.2, 7.0]), (4, None, [1.0, 1.0]), (5, 2, None),
            (6, 2, [nan, 1.0]), (7, 2, [1.0, inf]), (8, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (10, 2, [0.0, 0.0]), (11, 2, []), (20, 3, [1.0, 1.0]), (-10, 1, [-1.0, 0.5]),
            (12, 1, [0.0, 0.0])]
    assert sorted(map(tuple, mined(spark, rows).collect())) == brute(whole(rows), lambda i: i % 10 == 0)
    assert mined(spark, rows[:0]).count() == 0
    assert mined(spark, rows[2:3]).count() == 0


def test_lists_end_early():
    """Where one direction dominates, few rows are scored; the result stays that of all rows."""
    draw = np.random.default_rng(1)
    n = 2000
    x = np.column_stack((draw.integers(0, 10_000, n), draw.integers(0, 3, n)))
    order = np.argsort(x.T, axis=1, kind="stable")
    shard = {"rows": n, "ids": pack(np.arange(n)), "labels": pack(np.zeros(n, np.int64)), "x": pack(x), "more": pack(order)}
    search = hardneg.WindowSearch({"rows": 1, "keys": np.zeros(1, "<i8").tobytes(), "ids": pack(np.array([-1])), "labels": pack(np.array([0])),
                                   "x": pack(np.array([[50, 1]])), "more": pack(np.zeros((1, 0), np.int64))}, 5, True)
    search.scan(shard)
    score = x @ [50, 1]
    best = np.lexsort((np.arange(n), -score))[:5]
    assert search.best.ids[0].tolist() == best.tolist() and search.scored < n // 4
    scored = search.scored
    search.scan({"rows": 10, "ids": pack(np.arange(10)), "labels": pack(np.zeros(10, np.int64)), "x": pack(np.ones((10, 2), np.int64)),
                 "more": pack(np.tile(np.arange(10), (2, 1)))})
    assert search.scored == scored  # the tops of its lists are below the fifth score


def test_top_lists():
    best = TopLists(2, 2)
    best.add(np.array([0, 0, 0]), np.array([5, 5, 5]), np.array([9, 3, 7]))
    best.add(np.array([0, 1]), np.array([5, -1]), np.array([1, 4]))
    assert best.ids.tolist()[0] == [1, 3] and best.least().tolist() == [5, NONE]
    assert [v.tolist() for v in best.entries()] == [[0, 0, 1], [5, 5, -1], [1, 3, 4]]
