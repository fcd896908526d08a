"""The head, its scores over Arrow batches, and the decision columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import decisions as D
from tamis.functions import vectors as V
from tamis.functions.numeric import lists, matrix, softmax_rows
from tamis.operators.neighbours import MAX_REFERENCE_ROWS, ReferenceSet, bounded_reference, distances, fits_in_task, knn_distance


@dataclass(frozen=True)
class Head:
    """A linear head with its decision settings. The size is classes x dimensions, whatever the number of rows scored."""

    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    k: int = 10
    cutoff: float | None = None
    local_cutoff: float | None = None
    high_band: float | None = None
    prior_strength: float = 1.0
    routed: tuple[int, ...] = field(default_factory=tuple)
    version: str = "head"

    @property
    def dim(self) -> int:
        return int(self.weights.shape[1])

    def with_settings(self, **changes) -> Head:
        return replace(self, **changes)


def class_sums(df: DataFrame, vector: str = "e", by: str = "class_idx") -> DataFrame:
    """(by, i, n, x): number of rows and sum per class and dimension. Batches are summed before the shuffle."""

    def partial(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            m = matrix(b.column(1))
            key = np.asarray(b.column(0).to_numpy(zero_copy_only=False))
            kinds, at = np.unique(key, return_inverse=True)
            sums = np.zeros((len(kinds), m.shape[1]))
            np.add.at(sums, at, m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.astype(np.int32)), pa.array(np.bincount(at).astype(np.int64)), lists(sums)],
                names=[by, "n", "s"])

    parts = df.select(F.col(by).cast("int").alias(by), vector).mapInArrow(partial, f"{by} int, n bigint, s array<double>")
    long = parts.select(by, "n", F.posexplode("s").alias("i", "x"))
    return long.groupBy(by, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def class_centroids(df: DataFrame, vector: str = "e", by: str = "class_idx") -> DataFrame:
    """(by, n, centroid): one value per dimension and class is gathered."""
    return class_sums(df, vector, by).groupBy(by).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "n"))), lambda t: t["x"] / t["n"]).alias("centroid"))


def dimension_stats(df: DataFrame, vector: str = "e") -> DataFrame:
    """(dim, mean, sd): mean and population sd + 1e-6 per dimension, from merged batch moments."""

    def partial(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            m = matrix(b.column(0))
            mean = m.mean(axis=0)
            square = ((m - mean) ** 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(m.shape[1], dtype=np.int32)), pa.array(np.full(m.shape[1], len(m), dtype=np.int64)),
                 pa.array(mean), pa.array(square)], names=["dim", "n", "mean", "m2"])

    parts = df.select(vector).mapInArrow(partial, "dim int, n bigint, mean double, m2 double")
    total = parts.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("m2").alias("w"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    variance = (F.col("w") + F.greatest(F.lit(0.0), F.col("q") - F.col("n") * mean * mean)) / F.col("n")
    return total.select("dim", mean.alias("mean"), (F.sqrt(variance) + 1e-6).alias("sd"))


def centroid_head(df: DataFrame, classes: Sequence[str], scale: float = 8.0, vector: str = "e", by: str = "class_idx",
                  **settings) -> Head:
    """A head whose weights are scaled class centroids; absent classes are zero rows. Classes x dimensions numbers reach
    the driver."""
    cells = class_sums(df, vector, by).toArrow()
    at = cells.column(by).to_numpy(), cells.column("i").to_numpy()
    w = np.zeros((len(classes), int(at[1].max()) + 1))
    w[at] = scale * cells.column("x").to_numpy() / cells.column("n").to_numpy()
    return Head(tuple(classes), w, np.zeros(len(classes)), **settings)


def score(df: DataFrame, head: Head, reference: ReferenceSet | None = None, local: ReferenceSet | None = None,
          vector: str = "e") -> DataFrame:
    """Adds logits, probs, top, max_prob, distance and local_distance in one narrow pass over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(
        (head.weights, head.bias, head.temperature, head.k, reference.unit if reference is not None else None,
         local.unit if local is not None else None))
    position = df.columns.index(vector)
    schema = df.select("*", F.lit(None).cast("array<double>").alias("logits"), F.lit(None).cast("array<double>").alias("probs"),
                       F.lit(None).cast("int").alias("top"), F.lit(None).cast("double").alias("max_prob"),
                       F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("local_distance")).schema

    def run(batches):
        w, b, t, k, ref, near = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            e = matrix(batch.column(position))
            z = e @ w.T + b
            p = softmax_rows(z / t)
            top = p.argmax(axis=1)
            none = pa.nulls(len(e), pa.float64())
            d = pa.array(distances(e, ref, k)) if ref is not None and len(ref) else none
            dl = pa.array(distances(e, near, 1)) if near is not None and len(near) else none
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists(z), lists(p), pa.array(top.astype(np.int32)),
                 pa.array(p[np.arange(len(e)), top]), d, dl],
                names=[*batch.schema.names, "logits", "probs", "top", "max_prob", "distance", "local_distance"])

    return df.mapInArrow(run, schema)


def score_against(df: DataFrame, head: Head, reference: DataFrame, local: DataFrame | None = None, item_id: str = "item_id", vector: str = "e",
                  ref_id: str = "ref_id", max_rows: int = MAX_REFERENCE_ROWS) -> DataFrame:
    """`score` against tables of reference rows of any size: shipped to the tasks where they are checked to be small, else by the
    blocked neighbour join. The columns are the same and so are the distances. `item_id` must be unique."""
    near = local if local is not None else None
    if all(fits_in_task(r, vector, max_rows) for r in (reference, near) if r is not None):
        return score(df, head, bounded_reference(reference, ref_id, vector, max_rows=max_rows),
                     bounded_reference(near, ref_id, vector, max_rows=max_rows) if near is not None else None, vector)
    out = score(df, head, vector=vector).drop("distance", "local_distance")
    out = out.join(knn_distance(df, reference, head.k, item_id, vector, ref_id, max_rows=max_rows), item_id, "left")
    if near is None:
        return out.withColumn("local_distance", F.lit(None).cast("double"))
    return out.join(knn_distance(df, near, 1, item_id, vector, ref_id, out="local_distance", max_rows=max_rows), item_id, "left")


def decide(scored: DataFrame, head: Head, exclusive: bool = False) -> DataFrame:
    """Adds confident, familiar, routed, answered, reason, forced, band and familiar_by; an unknown distance means that
    no familiarity check applies."""
    confident = F.col("max_prob") >= F.lit(float(head.threshold))
    if head.cutoff is None:
        familiar = F.lit(True)
    else:
        familiar = F.col("distance").isNull() | D.is_familiar(
            F.col("distance"), float(head.cutoff), F.col("local_distance"), head.local_cutoff)
    routed = F.col("top").isin(*head.routed) if head.routed else F.lit(False)
    out = scored.withColumns({"confident": confident, "familiar": familiar, "routed": routed})
    reason = D.route_reason_exclusive if exclusive else D.route_reason
    out = out.withColumns({
        "answered": D.answered(F.col("confident"), F.col("familiar"), F.col("routed")),
        "reason": reason(F.col("confident"), F.col("familiar"), F.col("routed")),
        "forced": V.forced_prediction(F.col("probs"), head.routed)})
    by = (D.familiar_by(F.col("distance"), float(head.cutoff), F.col("familiar")) if head.cutoff is not None
          else F.lit(None).cast("string"))
    return out.withColumns({
        "band": D.confidence_band(F.col("max_prob"), float(head.threshold), ~F.col("answered"), head.high_band),
        "familiar_by": by})


def stratified_reference(df: DataFrame, per_class: int, by: str = "class_idx", item_id: str = "item_id", seed: str = "ref",
                         strict: bool = True) -> DataFrame:
    """Exactly `per_class` rows of each class in hash order; it fails when a class is short, unless `strict` is switched off."""
    from tamis.operators.splits import sample_cap_per_class

    picked = sample_cap_per_class(df, per_class, by, item_id, seed)
    if strict:
        short = [r[by] for r in picked.groupBy(by).count().where(F.col("count") < per_class).collect()]  # one row per class
        if short:
            raise ValueError(f"classes with fewer than {per_class} rows: {sorted(short)}")
    return picked
