"""Semantic traps of the decision, review and text rules."""

from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import decisions as D
from tamis.functions import text as T
from tamis.functions import vectors as V
from tamis.functions.numeric import softmax_rows
from tamis.operators import review as R
from tamis.operators import splits as X
from tamis.operators.raters import rater_pairs


def test_reason_orders_differ(spark):
    rows = [(c, f, r) for c in (True, False) for f in (True, False) for r in (True, False)]
    df = spark.createDataFrame(rows, "c boolean, f boolean, r boolean")
    got = df.select("*", D.route_reason(F.col("c"), F.col("f"), F.col("r")).alias("a"),
                    D.route_reason_exclusive(F.col("c"), F.col("f"), F.col("r")).alias("b"),
                    D.answered(F.col("c"), F.col("f"), F.col("r")).alias("ans")).collect()
    for r in got:
        assert (r.a is None) == (r.b is None) == r.ans
        if r.r:
            assert r.a == "other_problem"
        if not r.f:
            assert r.b == "unfamiliar"


def test_final_label_and_waiting(spark):
    rows = [(1, "skip", False, False, "rust"), (2, "skip", True, False, None), (3, None, False, True, "rust"), (4, "healthy", True, True, None),
            (5, None, True, False, None)]
    df = spark.createDataFrame([(i, 1, o, n, d, lab, None) for i, o, n, d, lab in rows],
                               "photo_id int, plot_id int, officer_label string, not_sure boolean, disputed boolean, label string, tree int")
    assert {r.photo_id: r.final_label for r in R.with_final_label(df).collect()} == {1: "rust", 2: None, 3: None, 4: "healthy", 5: None}
    row = R.visit_counts(df, ["rust"]).first()
    assert (row.waiting, row.card_waiting, row.card_disputed, row.answered) == (2, 1, 1, 2)


def test_missing_tree_counts_as_a_tree(spark):
    df = spark.createDataFrame([(1, 1, "rust", False, False, None, t) for t in (None, 2)],
                               "photo_id int, plot_id int, officer_label string, not_sure boolean, disputed boolean, label string, tree int")
    assert R.visit_counts(df, []).first().verdict == "officer_alert"


def test_familiarity_with_missing_values(spark):
    df = spark.createDataFrame([(0.4, None), (0.6, 0.1), (0.6, None), (None, 0.1)], "d double, l double")
    got = [r[0] for r in df.select(D.is_familiar(F.col("d"), 0.5, F.col("l"), 0.2)).collect()]
    assert got == [True, True, False, True]


def test_spot_check_rate_is_repeatable(spark):
    df = spark.range(50_000).withColumn("s", D.spot_check(F.col("id"), F.lit(True)))
    n = df.where("s").count()
    assert 4700 < n < 5300 and n == df.repartition(3).where("s").count()


def test_cells(spark):
    df = spark.createDataFrame([("=1+1",), ("-x",), ("a,b",), ('say "hi"',), (None,), ("plain",), ("@x\r\ny",)], "s string")
    assert [r[0] for r in df.select(T.csv_cell(F.col("s"))).collect()] == ["'=1+1", "'-x", '"a,b"', '"say ""hi"""', "", "plain", '"\'@x\r\ny"']


def words_distance(a, b):
    """From the definition: drop the first word of one side, of the other, or of both."""

    @lru_cache(maxsize=None)
    def between(rest_a, rest_b):
        if not rest_a or not rest_b:
            return len(rest_a) + len(rest_b)
        if rest_a[0] == rest_b[0]:
            return between(rest_a[1:], rest_b[1:])
        return 1 + min(between(rest_a[1:], rest_b), between(rest_a, rest_b[1:]), between(rest_a[1:], rest_b[1:]))

    return between(tuple(a), tuple(b))


def test_word_distance(spark):
    rng = np.random.default_rng(0)
    rows = [(" ".join(f"w{k}" for k in rng.integers(0, 400, rng.integers(0, 60))), " ".join(f"w{k}" for k in rng.integers(0, 400, 40)))
            for _ in range(30)] + [("a b c", "a x c"), ("ĩa ũb", "ũb ĩa")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", T.word_distance(T.words(F.col("a")), T.words(F.col("b"))).alias("d")).collect()
    assert all(r.d == words_distance(r.a.split(), r.b.split()) for r in got)


def test_pseudonyms(spark):
    df = spark.createDataFrame([("12",), (None,)], "m string")
    a, b = [r[0] for r in df.select(T.pseudonymise(F.col("m"))).collect()]
    salted = df.select(T.pseudonymise(F.col("m"), salt="secret")).first()[0]
    assert len(a) == 64 and b is None and salted != a


def test_fallback_chain(spark):
    df = spark.createDataFrame([({"kik": " ", "sw": "habari ", "en": "hi"},), ({"en": "hi"},), ({"kik": "x"},), ({"fr": "y"},)], "t map<string,string>")
    got = [tuple(r[0]) for r in df.select(D.text_with_fallback(F.col("t"), ("kik", "sw", "en"))).collect()]
    assert got == [("habari", "sw", True), ("hi", "en", True), ("x", "kik", False), ("", "en", True)]


def test_quantisation_error(spark):
    v = np.random.default_rng(1).normal(size=(50, 16))
    df = spark.createDataFrame([([float(x) for x in r],) for r in v], "v array<double>")
    got = df.select("v", V.quantise(F.col("v")).alias("q"), V.quantise_scale(F.col("v")).alias("s")).collect()
    for r in got:
        assert np.abs(np.array(r.q) * r.s - np.array(r.v)).max() <= r.s / 2 + 1e-9


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [list(r[0]) for r in df.select(V.l2_normalise(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    assert df.select(V.cosine(F.col("v"), F.col("v"))).first()[0] == 0.0


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(V.argmax(F.col("p"))).first()[0] == 1
    assert df.select(V.forced_prediction(F.col("p"), [1, 2])).first()[0] == 0


def test_seats(spark):
    df = spark.createDataFrame([("1", 330), ("2", 154), ("3", 59), ("4", 28)], "level string, n bigint")
    assert {r.level: r.seats for r in X.largest_remainder(df, "level", "n", 30).collect()} == {"1": 17, "2": 8, "3": 3, "4": 2}


def test_no_unit_straddles(spark):
    df = spark.range(500).withColumn("u", F.col("id") % 37).withColumn("c", F.col("id") % 3)
    assert X.straddling_units(X.group_holdout(df, "u", 0.15, "s"), "u", "split").count() == 0
    folds = X.group_kfold(df, "u", "c", 5, "s")
    assert X.straddling_units(folds, "u", "fold").count() == 0 and folds.select("fold").distinct().count() == 5


def test_rater_pairs_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(r, i, [None, "not_sure", "healthy", "rust"][rng.integers(0, 4)]) for r in "ABC" for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "rater string, item_id int, answer string")
    have = {(r, i): a for r, i, a in rows}
    for got in rater_pairs(df, items_per_block=20).collect():
        both = [(have[got.rater_a, i], have[got.rater_b, i]) for i in range(60) if (got.rater_a, i) in have and (got.rater_b, i) in have]
        sure = [(a, b) for a, b in both if a not in (None, "not_sure") and b not in (None, "not_sure")]
        assert (got.n_items, got.n_same, got.n_both, got.n_same_side) == (
            len(both), sum(a == b for a, b in both), len(sure), sum((a == "healthy") == (b == "healthy") for a, b in sure))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=3, max_size=3), min_size=1, max_size=8))
def test_softmax_rows(z):
    p = softmax_rows(np.array(z))
    assert p.sum(axis=1) == pytest.approx(np.ones(len(z)))
    assert (np.take_along_axis(p, np.array(z).argmax(axis=1)[:, None], 1)[:, 0] == p.max(axis=1)).all()
