"""Similarity joins, copy groups, linkage and neighbours against brute force, with cells and blocks forced small and a
group of copies that holds a third of all rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.operators import components as CC
from tamis.operators import linkage as LK
from tamis.operators import neighbours as N
from tamis.operators import similarity as SIM

SMALL = {"cell_rows": 20, "block_rows": 8, "max_pivots": 7}


def vectors(n=150, d=12, seed=0, hot=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = centres[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, d))
    if hot:
        v[: n // 6] = centres[0]                                               # identical rows
        v[n // 6: n // 3] = centres[0] + 0.01 * rng.normal(size=(n // 3 - n // 6, d))  # near copies of them
    return np.round(v, 6)


def frame(spark, v, labels=None):
    rows = [(i, [float(x) for x in r], str(labels[i]) if labels is not None else "x") for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "item_id bigint, e array<double>, label string").repartition(5)


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def components(s):
    n = len(s)
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min(root[i], root[s[i]].min(initial=n)) for i in range(n)])
        if (new == root).all():
            return root
        root = new
    return root


@pytest.mark.parametrize("tau", [0.5, 0.9, 0.98])
@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_pairs_are_complete(spark, tau, sizes):
    v = vectors()
    rep = {}
    for i, r in enumerate(v):
        rep.setdefault(tuple(r), []).append(i)
    keep = [m[0] for m in rep.values()]
    s = cosines(v)
    want = {(a, b): (len(rep[tuple(v[a])]), len(rep[tuple(v[b])])) for x, a in enumerate(keep) for b in keep[x + 1:] if s[a, b] > tau}
    got = SIM.similarity_self_join(frame(spark, v), tau, **sizes).collect()
    # a row (a, a) stands for the pairs among the copies of a
    want |= {(m[0], m[0]): (len(m), len(m)) for m in rep.values() if len(m) > 1}
    assert len(got) == len(want)
    assert {(r.a, r.b): (r.copies_a, r.copies_b) for r in got} == want
    assert all(r.similarity == 1.0 for r in got if r.a == r.b)


@pytest.mark.parametrize("tau", [0.6, 0.95])
def test_copy_groups_are_the_components(spark, tau):
    v = vectors(seed=1)
    s = cosines(v) > tau
    np.fill_diagonal(s, False)
    s |= (v[:, None, :] == v[None, :, :]).all(axis=2)
    got = {r.item_id: r.copy_group for r in CC.copy_groups(frame(spark, v), tau, **SMALL).collect()}
    assert got == {i: int(c) for i, c in enumerate(components(s))}


@pytest.mark.parametrize("chunk", [7, 1000])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_long_chain_and_star(spark, chunk, kind):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    edges = spark.createDataFrame(chain + star + star[:9] + [(5, 5)], "a bigint, b bigint").select(*[F.lpad(c, 4, "0").cast(kind).alias(c) for c in "ab"])
    want = {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(201)}}
    got = CC.connected_components(edges, chunk=chunk).collect()
    assert len(got) == len(want) and {int(r.node): int(r.component) for r in got} == want
    below = CC.connected_components(edges, rows=edges.count(), roots=False, chunk=chunk).collect()
    assert {int(r.node): int(r.component) for r in below} == {k: v for k, v in want.items() if k != v}


def test_random_edges_in_chunks(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 900, (2, 700))
    matrix = np.zeros((900, 900), bool)
    matrix[a, b] = matrix[b, a] = True
    want = components(matrix)
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a bigint, b bigint")
    for chunk in (20, 300, 5000):
        got = {r.node: r.component for r in CC.connected_components(edges, chunk=chunk).collect()}
        assert got == {n: int(want[n]) for n in {x for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y} | {
            y for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}}
    assert CC.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("tau", [0.7, 0.95])
def test_cross_label_twins(spark, tau):
    v = vectors(seed=2)
    labels = np.random.default_rng(3).integers(0, 3, len(v))
    s = cosines(v) >= tau - 1e-15
    other = labels[:, None] != labels[None, :]
    want = {i for i in range(len(v)) if (s[i] & other[i]).any()}
    twins, counts = SIM.cross_label_twins(frame(spark, v, labels), tau, "label", **SMALL)
    assert {r.item_id for r in twins.collect()} == want
    pairs = {(r.label, r.other): r.n for r in counts.collect()}
    for a in range(3):
        for b in range(3):
            n = sum(1 for i in range(len(v)) if labels[i] == a and (s[i] & (labels == b)).any()) if a != b else 0
            assert pairs.get((str(a), str(b)), 0) == n


def test_near_copy_anti_join(spark):
    v = vectors(seed=4)
    s = cosines(v)
    rows = frame(spark, v)
    left, right = rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1")
    got = {r.item_id for r in SIM.near_copy_anti_join(left, right, 0.9, **SMALL).collect()}
    assert got == {i for i in range(0, len(v), 2) if not (s[i, 1::2] > 0.9).any()}


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("sizes", [SMALL, {"cell_rows": 1000, "block_rows": 16}])
def test_blocked_neighbours_match_brute_force(spark, hot, sizes):
    v = vectors(seed=5, hot=hot)
    s = cosines(v)[:, 40:]
    ref = frame(spark, v).where("item_id >= 40").withColumnRenamed("item_id", "ref_id")
    got = N.blocked_neighbours(frame(spark, v), ref, 7, **sizes).collect()
    best = {}
    for r in got:
        best.setdefault(r.item_id, []).append(r.similarity)
    assert set(best) == set(range(len(v)))
    for i in range(len(v)):
        np.testing.assert_allclose(sorted(best[i], reverse=True), np.sort(s[i])[::-1][:7], atol=1e-12)


def test_neighbours_leave_out_the_own_group(spark):
    v = vectors(seed=6)
    rows = frame(spark, v, np.arange(len(v)) // 10)
    s = cosines(v)
    g = np.arange(len(v)) // 10
    s[g[:, None] == g[None, :]] = -np.inf
    ref = rows.withColumnRenamed("item_id", "ref_id")
    small = N.bounded_reference(ref, group="label")
    for got in (N.neighbours(rows, small, 4, group="label"), N.blocked_neighbours(rows, ref, 4, group="label", **SMALL)):
        best = {}
        for r in got.collect():
            best.setdefault(r.item_id, []).append(r.similarity)
        for i in range(len(v)):
            np.testing.assert_allclose(sorted(best[i], reverse=True), np.sort(s[i])[::-1][:4], atol=1e-12)


def test_fewer_reference_rows_than_k(spark):
    v = vectors(n=30, seed=7, hot=False)
    ref = frame(spark, v).where("item_id < 3").withColumnRenamed("item_id", "ref_id")
    want = 1 - cosines(v)[:, :3].mean(axis=1)
    for rows in (N.MAX_REFERENCE_ROWS, 0):
        got = {r.item_id: r.distance for r in N.knn_distance(frame(spark, v), ref, 10, max_rows=rows).collect()}
        np.testing.assert_allclose([got[i] for i in range(30)], want, atol=1e-12)
    empty = N.nearest_distance(frame(spark, v), ref.where("ref_id < 0"))
    assert empty.count() == 30 and empty.where("distance is not null").count() == 0


@pytest.mark.parametrize("k", [1, 5, 30])
def test_reference_tiles_give_the_same_neighbours(monkeypatch, k):
    monkeypatch.setattr(N, "REFERENCE_TILE", 16)
    v = vectors(seed=8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    g = np.arange(len(v)) % 9
    s[g[:, None] == g[None, :]] = -np.inf
    row, col, value = N._nearest(u, u, k, g, g)
    assert (np.bincount(row, minlength=len(v)) == k).all()
    np.testing.assert_allclose(value.reshape(len(v), k), -np.sort(-s, axis=1)[:, :k], atol=1e-11)
    np.testing.assert_allclose(N.distances(v, u, k), 1 - np.sort(u @ u.T, axis=1)[:, -k:].mean(axis=1), atol=1e-12)
    low = value.reshape(len(v), k)[:, -1]
    kept = N._nearest(u, u, k, g, g, low)
    assert kept[0].tolist() == row.tolist() and kept[1].tolist() == col.tolist()


def test_equal_neighbours_come_by_place(monkeypatch):
    monkeypatch.setattr(N, "REFERENCE_TILE", 4)
    same = np.tile(np.eye(3)[[0]], (20, 1))
    row, col, _ = N._nearest(np.eye(3)[[0, 1]], same, 3)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and col.tolist() == [0, 1, 2, 0, 1, 2]


def test_memory_of_a_search_is_bounded():
    """A task multiplies tiles: its memory doesn't grow with the reference."""
    rng = np.random.default_rng(9)
    q, ref = rng.normal(size=(1024, 4)), rng.normal(size=(60_000, 4))
    for search in (lambda: N.distances(q, ref, 10), lambda: N._nearest(q, ref, 10, np.arange(1024), np.arange(60_000))):
        tracemalloc.start()
        search()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 250e6  # one product with all rows has 490 MB


def test_copies_for_blocks_are_sent_in_bounded_batches():
    """A batch that needs all blocks of a large reference isn't copied at once."""
    n, cells = 5_000, np.arange(100)
    parts = {c: 5 for c in range(100)}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32) % 100), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)),
         pa.array([[1.0]] * n), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], names=["cell", "part", "id", "v", "grp", "low"])
    total = 0
    for b in N._copies(batch, lambda b: (cells, np.ones((b.num_rows, 100), bool)), parts):
        assert b.num_rows <= N.SEND_ROWS
        total += b.num_rows
    assert total == n * 499  # every block but the one of the first pass


def average_linkage(s, cut):
    groups = [[i] for i in range(len(s))]
    while len(groups) > 1:
        best, at = -np.inf, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                m = s[np.ix_(groups[i], groups[j])].mean()
                if m > best + 1e-12:
                    best, at = m, (i, j)
        if best < cut:
            break
        i, j = at
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("cut", [0.7, 0.9])
@pytest.mark.parametrize("limit", [1500, 12])
def test_average_linkage(spark, cut, limit):
    v = vectors(n=60, seed=8)
    got = {}
    for r in LK.average_linkage_groups(frame(spark, v), cut, local_limit=limit, block_rows=6).collect():
        got.setdefault(r.unit, set()).add(r.item_id)
    assert {frozenset(g) for g in got.values()} == average_linkage(cosines(v), cut)
    assert all(min(g) == u for u, g in got.items())


@pytest.mark.parametrize("seed", range(3))
def test_linkage_on_ties(spark, seed):
    """Many equal similarities: the plan for large components and the one for small ones give the same tree at every cut."""
    draw = np.random.default_rng(seed)
    v = draw.integers(-1, 2, size=(40, 3)) + np.array([3, 0, 0])
    v = np.vstack([v, 2 * v[:5]])  # equal directions
    cuts = {"fine": 0.95, "coarse": 0.8}
    runs = [{r.item_id: (r.fine, r.coarse) for r in LK.average_linkage_cuts(frame(spark, v), cuts, local_limit=limit, block_rows=6).collect()}
            for limit in (1500, 4)]
    assert runs[0] == runs[1]
    assert all(len({runs[0][j][1] for j in runs[0] if runs[0][j][0] == f}) == 1 for f, _ in runs[0].values())  # the fine cut refines the coarse


def test_linkage_in_one_task_equals_one_merge_at_a_time():
    draw = np.random.default_rng(5)
    u = draw.normal(size=(40, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    merges = LK.linkage_merges(u, np.ones(40), 0.3)
    for cut in (0.3, 0.6, 0.9):
        numbers = LK.cluster_numbers(40, merges, cut)
        assert {frozenset(np.flatnonzero(numbers == k).tolist()) for k in set(numbers.tolist())} == average_linkage(u @ u.T, cut)
