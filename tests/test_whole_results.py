"""Sizes, delays and empty keys choose a plan; they don't change or drop results."""

import subprocess
import sys
from math import comb
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions.numeric import beta_cdf
from tamis.operators import calibration as C
from tamis.operators import metrics as M
from tamis.operators import neighbours as N
from tamis.operators import scoring as S
from tamis.operators import similarity as SIM
from tamis.operators import splits as X
from tamis.operators import stacked as ST
from tamis.plans import experiments as E
from tamis.session import scratch_path
from tamis.sources import exports
from tamis.streaming import jobs as J


def table(spark, vectors, name="item_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} bigint, e array<double>")


def test_a_large_reference_gives_the_same_decisions(spark):
    draw = np.random.default_rng(0)
    rows, reference = table(spark, draw.normal(size=(40, 8))), table(spark, draw.normal(size=(30, 8)), "ref_id")
    local = table(spark, draw.normal(size=(9, 8)), "ref_id")
    head = S.Head(("a", "b"), draw.normal(size=(2, 8)), np.zeros(2), k=5, cutoff=0.4, local_cutoff=0.3, threshold=0.5)
    names = ["item_id", "answered", "reason", "distance", "local_distance"]
    small = S.decide(S.score_against(rows, head, reference, local), head).select(names).orderBy("item_id").collect()
    large = S.decide(S.score_against(rows, head, reference, local, max_rows=4), head).select(names).orderBy("item_id").collect()
    assert {r.reason for r in small} > {"unfamiliar"}
    for a, b in zip(small, large, strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and abs(a.distance - b.distance) < 1e-9 and abs(a.local_distance - b.local_distance) < 1e-9
    with pytest.raises(N.ReferenceTooLarge):
        N.bounded_reference(reference, max_rows=4)
    with pytest.raises(N.ReferenceTooLarge):
        N.bounded_reference(reference, max_bytes=100)


def test_late_records_are_merged(spark):
    """Replays are dropped, records that come long after the others are kept, and a batch may be tried again."""
    day = "timestamp '2024-01-01' + make_interval(0, 0, 0, {})"
    first = spark.sql(f"select * from values (1, {day.format(120)}), (2, {day.format(121)}), (cast(null as int), {day.format(120)}) t(id, ts)")
    later = spark.sql(f"select * from values (1, {day.format(120)}), (3, {day.format(1)}), (3, {day.format(1)}), (cast(null as int), {day.format(120)}) t(id, ts)")
    path = scratch_path(spark, "merge")
    sink = J.merge_once(spark, first.schema, ["id", "ts"], path)
    for batch, number in ((first, 0), (later, 1), (later, 1)):
        sink(batch, number)
    assert sorted(r.id or 0 for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_seeds_give_orders_of_their_own(spark):
    rows = spark.range(60).select(F.col("id").alias("item_id"), (F.col("id") % 12).alias("g")).crossJoin(
        spark.createDataFrame([(1,), (2,)], "seed int"))
    picked = X.one_per_group(rows, "g", "item_id", F.col("seed").cast("string"), ["seed"])
    by_seed = {s: {(r.g, r.item_id, r.place) for r in picked.where(F.col("seed") == s).collect()} for s in (1, 2)}
    assert {x[1] for x in by_seed[1]} != {x[1] for x in by_seed[2]}
    assert [x[2] for x in sorted(by_seed[1])] != [x[2] for x in sorted(by_seed[2])]


def test_identical_rows_are_pairs(spark):
    rows = table(spark, [[1, 0], [1, 0], [1, 0], [0, 1], [0.999, 0.02]])
    got = {(r.a, r.b, r.copies_a, r.copies_b) for r in SIM.similarity_self_join(rows, 0.9).collect()}
    assert got == {(0, 0, 3, 3), (0, 4, 3, 1)}


def test_keys_without_usable_rows_keep_a_threshold(spark):
    rows = spark.createDataFrame([("x", 0.8, True, False, 1, 1)] * 30 + [("y", 0.1, False, False, 1, 1)], "k string, max_prob double, familiar boolean, routed boolean, top int, y int")
    got = {r.k: r.threshold for r in C.select_threshold(rows, "y", target=0.9, least=20, by=["k"]).collect()}
    assert got["y"] == 0.0 and set(got) == {"x", "y"}


def test_incomplete_beta():
    for a, b, x in ((3, 7, 0.3), (1, 1, 0.25), (10, 2, 0.9), (50, 60, 0.4), (1, 40, 0.001)):
        n = a + b - 1
        exact = sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert abs(beta_cdf(x, np.array([a]), np.array([b]))[0] - exact) < 1e-12
    assert abs(beta_cdf(0.3, np.array([0.5]), np.array([0.5]))[0] - 2 / np.pi * np.arcsin(np.sqrt(0.3))) < 1e-12
    # near its mean the law is normal with a skewness term: P(T < mean) = 1/2 + (1 - 2 mean) / (3 sqrt(2 pi n mean (1 - mean)))
    for n in (1e6, 1e8, 1e9):
        got = beta_cdf(0.25, np.array([0.25 * n]), np.array([0.75 * n]))[0]
        assert abs(got - 0.5 - 0.5 / (3 * np.sqrt(2 * np.pi * n * 0.1875))) < 1e-8
    assert beta_cdf(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([3.0, 3.0])).tolist() == [0.0, 1.0]


def test_an_empty_export_has_its_header(spark, tmp_path):
    exports.write_csv(spark.createDataFrame([], "a string, b string"), str(tmp_path / "x"), single_file=True)
    assert "a,b" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "x").glob("part-*"))


def test_short_classes_fail_unless_allowed(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(9)], "item_id bigint, class_idx int")
    with pytest.raises(ValueError):
        S.stratified_reference(rows, 5)
    assert S.stratified_reference(rows, 5, strict=False).count() == 9


def test_queries_run_from_any_folder(tmp_path):
    """The package reaches the Python workers although the folder of the job isn't that of the package."""
    home = Path(__file__).resolve().parents[1]
    code = ("import importlib.util as u; s = u.spec_from_file_location('e', r'%s'); m = u.module_from_spec(s); s.loader.exec_module(m); "
            "from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".config('spark.checkpoint.dir', r'%s').getOrCreate(); print('ROWS', m.queries()['p05_top_class'](spark, '/root/testdata/sf0.001').count())"
            % (home / "__spark_entry__.py", tmp_path / "shared"))
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]


def test_unknown_distances_mean_no_check(spark):
    """Without any reference row the curve and the rule agree: no familiarity check applies."""
    draw = np.random.default_rng(3)
    rows = table(spark, draw.normal(size=(40, 4))).withColumn("unit", F.col("item_id")).withColumn("grp", F.col("item_id")).withColumn(
        "class_idx", (F.col("item_id") % 2).cast("int"))
    head = S.Head(("a", "b"), draw.normal(size=(2, 4)), np.zeros(2), k=3, cutoff=0.1, threshold=0.5)
    nothing = N.ReferenceSet(np.zeros(0, np.int64), np.zeros((0, 4)))
    out = E.learning_outcomes(rows, head, nothing, "unit", "grp", (1, 2), (0,), ("prior",))
    assert out.where("reason = 'unfamiliar'").count() == 0 and out.count() > 0


def test_training_pool_keeps_copies_together(spark):
    """Copies share a fold; a group with a held-out row or two labels goes; no lab row has a copy in the pool."""
    draw = np.random.default_rng(8)
    base = draw.normal(size=(90, 24))
    rows, group = [], {}
    for i, v in enumerate(base):
        split = ("train", "field", "field")[i % 3]
        for k in range(1 + (i % 4 > 0) + (i % 4 > 2)):
            item = i * 10 + k
            label = (i % 3 if i % 7 else 2) if not (k == 1 and i % 11 == 0) else 1 - i % 2
            # the copy of some lab rows is a field row
            rows.append((item, (v + draw.normal(size=24) * 0.002).tolist(), int(label), "field" if k == 1 and i % 9 == 0 else split))
            group[item] = i
    table = spark.createDataFrame(rows, "item_id bigint, e array<double>, class_idx int, split string")
    held = {r[0] for r in rows if r[3] == "field" and r[0] % 50 == 10}
    lab, pool = E.training_pool(table, table.where(F.col("item_id").isin(*held)), 2, 5, "t")
    lab, pool = [r.item_id for r in lab.collect()], {r.item_id: r.fold for r in pool.collect()}
    labels = {}
    for item, _, label, _ in rows:
        labels.setdefault(group[item], set()).add(label)
    banned = {group[i] for i in held} | {g for g, s in labels.items() if len(s) > 1}
    free = [r for r in rows if group[r[0]] not in banned]
    assert held and len(banned) > len(held)
    assert set(pool) == {i for i, _, label, split in free if split == "field" or label == 2}
    assert set(lab) == {i for i, _, label, split in free if split == "train" and label != 2 and group[i] not in {group[j] for j in pool}}
    assert all(len({f for i, f in pool.items() if group[i] == g}) == 1 for g in {group[i] for i in pool}) and set(pool.values()) == set(range(5))


def test_loss_by_strength(spark):
    draw = np.random.default_rng(9)
    heads = {c: {f: S.Head(("a", "b", "c"), draw.normal(size=(3, 6)), draw.normal(size=3)) for f in range(2)} for c in (0.1, 1.0, 3.0)}
    e, y, fold = draw.normal(size=(40, 6)), draw.integers(0, 3, 40), [0] * 12 + [1] * 13 + [None] * 15
    table = spark.createDataFrame([(a.tolist(), int(b), f) for a, b, f in zip(e, y, fold)], "e array<double>, class_idx int, fold int").repartition(3)
    got = {r.c: (r.n, r.nll) for r in ST.loss_by_strength(table.where("fold is not null"), table.where("fold is null"), heads).collect()}
    for c, by in heads.items():
        z = [np.mean([x @ h.weights.T + h.bias for h in (by.values() if f is None else [by[f]])], axis=0) for x, f in zip(e, fold)]
        assert got[c][0] == 40 and abs(got[c][1] - np.mean([np.log(np.exp(v).sum()) - v[k] for v, k in zip(z, y)])) < 1e-9


def test_summary_rows(spark):
    table = spark.createDataFrame([(0, 1.0, 2), (1, 3.0, 4)], "fold int, a double, n int")
    got = {(r.part, r.fold): (r.a, r.n) for r in E.with_summary(table).collect()}
    assert got == {("fold", 0): (1.0, 2.0), ("fold", 1): (3.0, 4.0), ("mean", None): (2.0, 3.0), ("sd", None): (1.0, 1.0)}


def test_added_rows_beyond_the_bound(spark):
    """Added rows that no task may hold give the same routing as shipped ones, and no error."""
    draw = np.random.default_rng(10)
    out_rows, reference = table(spark, draw.normal(size=(30, 8))), table(spark, draw.normal(size=(40, 8)), "ref_id")
    added = table(spark, draw.normal(size=(25, 8)), "ref_id").withColumn("ref_id", F.col("ref_id") + 1000)
    head = S.Head(("a", "b", "c"), draw.normal(size=(3, 8)), np.zeros(3), threshold=0.4, k=3, cutoff=0.35, local_cutoff=0.3, routed=(2,))
    adapted = head.with_settings(weights=draw.normal(size=(3, 8)))
    whole = {r.variant: r for r in E.out_of_scope_after_update(out_rows, head, adapted, reference, added).collect()}
    assert whole == {r.variant: r for r in E.out_of_scope_after_update(out_rows, head, adapted, reference, added, max_rows=10).collect()}
    ref, more = N.bounded_reference(reference), N.bounded_reference(added)
    both = N.ReferenceSet(np.r_[ref.ids, more.ids], np.vstack([ref.unit, more.unit]))
    for name, h, r, near in (("before", head, ref, None), ("after", adapted, both, more), ("refit_only", adapted, ref, None), ("rows_only", head, both, None)):
        h = h if near is not None else h.with_settings(local_cutoff=None)
        want = M.out_of_scope_metrics(S.decide(S.score(out_rows, h, r, near), h)).first()
        assert tuple(whole[name])[1:] == tuple(want)
