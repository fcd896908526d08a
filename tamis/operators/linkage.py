"""Average-linkage groups of near copies, cut at a similarity.

With unit vectors the average similarity of two clusters is the dot product of their mean vectors, so a cluster is its sum
vector and its size. A merge at average similarity >= cut needs one pair >= cut, so clusters never leave a connected
component of the pairs >= cut. Rounds merge all mutually nearest clusters at once, which gives the same tree as one merge after
the other because average linkage is reducible; on ties the smaller name is nearer. Small components run their rounds in one
task each, larger ones as jobs, by the same rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.functions.numeric import matrix
from tamis.operators.components import connected_components, copy_groups
from tamis.operators.similarity import BLOCK_ROWS, copy_map
from tamis.session import cut_lineage

LOCAL_LIMIT = 1_500


PLACES = 12  # similarities are compared at so many decimal places, so that ties are ties in every plan


def linkage_merges(sums: np.ndarray, sizes: np.ndarray, cut: float) -> list[tuple[int, int, float]]:
    """Merges (kept, gone, similarity) of weighted points, down to the similarity `cut`, by rounds: every cluster names its most
    similar other one, the first on ties, and all pairs that name each other merge. Only rows of merged clusters are computed anew."""
    sums, sizes = sums.copy(), sizes.astype(float).copy()
    names = np.arange(len(sums))
    means = sums / sizes[:, None]
    s = np.round(means @ means.T, PLACES)
    out: list[tuple[int, int, float]] = []
    while len(names) > 1:
        np.fill_diagonal(s, -np.inf)
        best = s.argmax(axis=1)
        near = s[np.arange(len(best)), best]
        kept = np.flatnonzero((near >= cut) & (best[best] == np.arange(len(best))) & (np.arange(len(best)) < best))
        if not len(kept):
            break
        gone = best[kept]
        out += zip(names[kept].tolist(), names[gone].tolist(), near[kept].tolist(), strict=True)
        sums[kept] += sums[gone]
        sizes[kept] += sizes[gone]
        stay = np.ones(len(names), bool)
        stay[gone] = False
        at = (np.cumsum(stay) - 1)[kept]
        names, sums, sizes, s = names[stay], sums[stay], sizes[stay], s[np.ix_(stay, stay)]
        means = sums / sizes[:, None]
        s[at] = np.round(means[at] @ means.T, PLACES)
        s[:, at] = s[at].T
    return out


def cluster_numbers(n: int, merges: Sequence[tuple[int, int, float]], cut: float) -> np.ndarray:
    """Cluster number per row after the merges of at least `cut`. A merge is never more similar than those it builds on, so these
    are whole subtrees."""
    owner = np.arange(n)
    for kept, gone, similarity in merges:
        if similarity >= cut:
            owner[owner == gone] = kept
    return owner


def _nearest_clusters(clusters: DataFrame, block_rows: int) -> DataFrame:
    """(c, other, similarity): the most similar other cluster of the same component, the smaller id on ties."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    work = clusters.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    part = F.col("part")
    slots = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.least(part, j).alias("x"), F.greatest(part, j).alias("y"), F.when(j < part, 1).otherwise(0).alias("side")))
    mean = F.transform("s", lambda v: v / F.col("size"))
    rows = work.select("component", "c", mean.alias("m"), F.explode(slots).alias("t")).select(
        "component", "t.x", "t.y", "t.side", "c", "m")

    def nearest(table: pa.Table) -> pa.Table:
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        table = table.sort_by("c")
        ids, m, side = table.column("c").to_numpy(), matrix(table.column("m")), table.column("side").to_numpy()
        a = np.ones(len(ids), bool) if same else side == 0
        b = a if same else ~a
        out = []
        if a.any() and b.any():
            s = np.round(m[a] @ m[b].T, PLACES)
            if same:
                np.fill_diagonal(s, -np.inf)
            passes = [(ids[a], ids[b], s)] if same else [(ids[a], ids[b], s), (ids[b], ids[a], s.T)]
            for own, other, t in passes:
                at = t.argmax(axis=1)
                top = t[np.arange(len(own)), at]
                ok = np.isfinite(top)
                out.append(pa.table({"c": own[ok], "other": other[at[ok]], "similarity": top[ok]}))
        schema = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    found = rows.groupBy("component", "x", "y").applyInArrow(nearest, "c bigint, other bigint, similarity double")
    return found.groupBy("c").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("t")).select(
        "c", (-F.col("t.o")).alias("other"), F.col("t.similarity").alias("similarity"))


def _solver(cuts: Sequence[float]):
    """Finish the clusters of one component, at most the local limit of them, in one task: (id, clusters by cut)."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        merges = linkage_merges(matrix(table.column("s")), table.column("size").to_numpy(), min(cuts))
        found = np.stack([ids[cluster_numbers(len(ids), merges, c)] for c in cuts], axis=1)
        return pa.table({"id": pa.array(ids), "clusters": pa.ListArray.from_arrays(
            pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(cuts)), pa.array(found.reshape(-1)))})

    return solve


def _merge_rounds(points: DataFrame, cuts: Sequence[float], local_limit: int, block_rows: int, max_rounds: int) -> DataFrame:
    """(id, clusters by cut) for points (id, component, s, size) of components too large for one task: the rounds of `linkage_merges`
    as jobs, until few enough clusters are left in a component for one task to finish it."""
    clusters = cut_lineage(points.select(F.col("id").alias("c"), "component", "s", "size"))
    merges = None
    for _ in range(max_rounds):
        counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
        large = clusters.join(counts.where(F.col("k") > local_limit), "component", "left_semi")
        near = cut_lineage(_nearest_clusters(large, block_rows).where(F.col("similarity") >= min(cuts)))
        back = near.select(F.col("c").alias("other"), F.col("other").alias("c"))
        mutual = cut_lineage(near.join(back, ["c", "other"]).where("c < other").select("c", "other", "similarity"))
        if mutual.isEmpty():
            break
        step = mutual.select(F.col("c").alias("a"), F.col("other").alias("b"), "similarity")
        merges = step if merges is None else merges.unionByName(step)
        gone = mutual.select(F.col("other").alias("c"), F.col("c").alias("into"))
        absorbed = clusters.join(gone, "c").select(F.col("into").alias("c"), F.col("s").alias("s2"), F.col("size").alias("n2"))
        rest = clusters.join(gone, "c", "left_anti").join(absorbed, "c", "left")
        clusters = cut_lineage(rest.select(
            "c", "component", F.when(F.col("s2").isNull(), F.col("s")).otherwise(
                F.zip_with("s", "s2", lambda x, y: x + y)).alias("s"),
            (F.col("size") + F.coalesce("n2", F.lit(0))).alias("size")))
    else:
        raise RuntimeError("linkage did not settle; raise max_rounds")
    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    few = clusters.join(counts.where(F.col("k") <= local_limit), "component", "left_semi").withColumnRenamed("c", "id")
    last = cut_lineage(few.groupBy("component").applyInArrow(_solver(cuts), "id bigint, clusters array<bigint>"))
    out = points.select("id")
    for i, cut in enumerate(cuts):
        edges = last.select(F.col("id").alias("a"), F.get("clusters", F.lit(i)).alias("b"))
        if merges is not None:
            edges = edges.unionByName(merges.where(F.col("similarity") >= cut).select("a", "b"))
        parts = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias(f"c{i}"))
        out = out.join(parts, "id", "left")
    return out.select("id", F.array(*[F.coalesce(f"c{i}", "id") for i in range(len(cuts))]).alias("clusters"))


def average_linkage_cuts(df: DataFrame, cuts: Mapping[str, float], item_id: str = "item_id", vector: str = "e",
                         local_limit: int = LOCAL_LIMIT, block_rows: int = BLOCK_ROWS, max_rounds: int = 10_000) -> DataFrame:
    """(item_id, one column per cut): the average-linkage cluster of each row at similarity >= cut, named by its smallest id. The
    cuts are read from one tree, and `local_limit` chooses the plan only."""
    names, values = list(cuts), [float(c) for c in cuts.values()]
    same = cut_lineage(copy_map(df.select(item_id, vector), item_id, vector))
    copies = same.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    groups = copy_groups(df, min(values), item_id, vector, strict=False, same=same)
    unit = V.l2_normalise(F.col(vector))
    points = (df.select(F.col(item_id).alias("rep"), unit.alias("u")).join(copies, "rep")
              .join(groups.select(F.col(item_id).alias("rep"), F.col("copy_group").alias("component")), "rep")
              .select(F.col("rep").alias("id"), "component", "size", F.transform("u", lambda x: x * F.col("size")).alias("s")))
    members = cut_lineage(points)
    counts = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    single = members.join(counts.where("n = 1"), "component", "left_semi").select(
        "id", F.array_repeat("id", len(values)).alias("clusters"))
    small = members.join(counts.where((F.col("n") > 1) & (F.col("n") <= local_limit)), "component", "left_semi")
    large = members.join(counts.where(F.col("n") > local_limit), "component", "left_semi")

    found = single.unionByName(small.groupBy("component").applyInArrow(_solver(values), "id bigint, clusters array<bigint>"))
    if not large.isEmpty():
        found = found.unionByName(_merge_rounds(large, values, local_limit, block_rows, max_rounds))
    return same.join(found, same["rep"] == found["id"]).select(
        item_id, *[F.get("clusters", F.lit(i)).alias(n) for i, n in enumerate(names)])


def average_linkage_groups(df: DataFrame, cut: float, item_id: str = "item_id", vector: str = "e", **sizes: int) -> DataFrame:
    """(item_id, unit): `average_linkage_cuts` at one cut."""
    return average_linkage_cuts(df, {"unit": cut}, item_id, vector, **sizes)
