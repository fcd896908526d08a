"""Many heads fitted at once: every fold and strength of a cross-validation in one pass over the rows per step.

The rows are packed once into blocks of a few thousand, each with its vectors, classes and folds as bytes. A step is one job: a task
multiplies its blocks with the stacked weights of all heads that are still moving and sends one sum of losses and gradients a
head. The quasi-Newton steps of each head are taken on the driver, where a head is classes x dimensions numbers. A head leaves the stack when
it has settled. Strengths of a fold are a path: the next one starts from the weights of the one before as soon as that one is near its end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import matrix
from tamis.operators.fitting import descent
from tamis.operators.scoring import Head
from tamis.session import cut_lineage

BLOCK_ROWS = 4096
TASK_CELLS = 1 << 21
NEAR = 1e-2
EVERY_ROW = -1


def packed_rows(df: DataFrame, vector: str = "e", label: str = "class_idx", fold: str | None = "fold") -> DataFrame:
    """(n, e, y, fold) blocks of rows as bytes; rows without a fold have EVERY_ROW there and belong to the training rows of all folds."""
    of = F.coalesce(F.col(fold).cast("int"), F.lit(EVERY_ROW)) if fold else F.lit(EVERY_ROW)
    rows = df.select(F.col(vector).alias("e"), F.col(label).cast("int").alias("y"), of.alias("fold"))

    def pack(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(first, BLOCK_ROWS)
                e = matrix(b.column(0)).tobytes()
                y, f = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([e], pa.binary()), pa.array([y], pa.binary()), pa.array([f], pa.binary())],
                                                 ["n", "e", "y", "fold"])

    return rows.mapInArrow(pack, "n bigint, e binary, y binary, fold binary")


@dataclass(frozen=True)
class Training:
    """The weight of each class in the training rows of a fold (0 for an absent class), and the sum of all weights."""

    weight: np.ndarray
    total: float

    @classmethod
    def balanced(cls, counts: np.ndarray, other_weight: float | None) -> Training:
        present = np.flatnonzero(counts)
        if not len(present):
            raise ValueError("no training rows")
        weight = np.zeros(len(counts))
        weight[present] = counts.sum() / (len(present) * counts[present])
        if other_weight is not None:
            weight[present[-1]] *= other_weight
        return cls(weight, float(weight @ counts))


def block_sums(e: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: np.ndarray, weights: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(heads x (1 + classes x dimensions + classes)): weighted loss and gradient of each head over the rows outside its fold. weights: heads x classes, 0
    for classes that a head doesn't know; w: heads x classes x dimensions; b: heads x classes."""
    heads, kinds, d = w.shape
    out = np.zeros((heads, 1 + kinds * d + kinds))
    flat, absent = w.reshape(heads * kinds, d), np.where(weights > 0, 0.0, -np.inf)
    step = max(64, TASK_CELLS // (heads * kinds))
    for first in range(0, len(y), step):
        rows, kind = e[first:first + step], y[first:first + step]
        z = (rows @ flat.T).reshape(len(rows), heads, kinds) + (b + absent)
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        mass = p.sum(axis=2)
        used = weights[:, kind].T * (fold[first:first + step, None] != folds)
        own = np.take_along_axis(z, kind[:, None, None], axis=2)[:, :, 0]
        out[:, 0] += np.where(used > 0, used * (np.log(mass) - np.where(used > 0, own, 0.0)), 0.0).sum(axis=0)
        p /= mass[:, :, None]
        p[np.arange(len(kind)), :, kind] -= 1.0
        p *= used[:, :, None]
        out[:, 1:1 + kinds * d] += (p.reshape(len(rows), heads * kinds).T @ rows).reshape(heads, kinds * d)
        out[:, 1 + kinds * d:] += p.sum(axis=0)
    return out


class _Stack:
    """Evaluates a stack of heads over the packed rows, one job for all of them."""

    def __init__(self, blocks: DataFrame, kinds: int, dim: int):
        self.blocks, self.kinds, self.dim, self.jobs = blocks, kinds, dim, 0

    def evaluate(self, folds: Sequence[int], weights: np.ndarray, points: np.ndarray) -> np.ndarray:
        heads, kinds, d = len(folds), self.kinds, self.dim
        cut = kinds * d
        shared = self.blocks.sparkSession.sparkContext.broadcast((np.array(folds), weights, points[:, :cut].reshape(heads, kinds, d), points[:, cut:]))
        width = 1 + cut + kinds

        def run(batches):
            of, known, w, b = shared.value
            total = np.zeros((heads, width))
            for batch in batches:
                for n, e, y, f in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    total += block_sums(np.frombuffer(e).reshape(n, d), np.frombuffer(y, np.int32), np.frombuffer(f, np.int32), of, known, w, b)
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["i", "x"])

        sums = self.blocks.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # numbers of the heads, not rows
        shared.unpersist()
        self.jobs += 1
        out = np.zeros(heads * width)
        out[sums["i"].to_numpy()] = sums["x"].to_numpy()
        return out.reshape(heads, width)


def fit_heads(df: DataFrame, grid: Sequence[float], classes: Sequence[str], folds: Sequence[int | None], vector: str = "e", label: str = "class_idx",
              fold: str | None = "fold", other_weight: float | None = None, tol: float = 1e-8, max_iter: int = 2000,
              start: dict[int | None, Head] | None = None) -> dict[float, dict[int | None, Head]]:
    """The heads of `fit_head` for every strength of `grid` and every fold: the head of fold f comes from all rows outside f, that of None from
    all rows. Rows with a null fold are training rows of every head. `start`: heads to begin from."""
    blocks = cut_lineage(packed_rows(df, vector, label, fold))
    of = F.coalesce(F.col(fold).cast("int"), F.lit(EVERY_ROW)) if fold else F.lit(EVERY_ROW)
    kinds = len(classes)
    counts: dict[int, np.ndarray] = {}
    for r in df.groupBy(of.alias("f"), F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():  # folds x classes
        counts.setdefault(r.f, np.zeros(kinds))[r.y] += r.n
    if not counts:
        raise ValueError("no training rows")
    whole = sum(counts.values())
    ids = {f: -2 if f is None else int(f) for f in folds}  # no row is in fold -2
    training = {f: Training.balanced(whole - counts.get(i, 0), other_weight) for f, i in ids.items()}
    dim = blocks.select((F.length("e") / 8 / F.col("n")).cast("int")).first()[0]
    stack, grid = _Stack(blocks, kinds, dim), [float(c) for c in grid]
    cut, size = kinds * dim, kinds * dim + kinds

    def begin(f, place, x):
        head = descent(x, tol, max_iter)
        return {"fold": f, "place": place, "steps": head, "x": next(head), "next": place + 1 < len(grid), "first": None}

    def origin(f):
        given = (start or {}).get(f)
        return np.zeros(size) if given is None else np.r_[given.weights.ravel(), given.bias]

    done: dict[float, dict[int | None, Head]] = {c: {} for c in grid}
    moving = [begin(f, 0, origin(f)) for f in folds]
    while moving:
        known = np.array([training[m["fold"]].weight for m in moving])
        sums = stack.evaluate([ids[m["fold"]] for m in moving], known, np.array([m["x"] for m in moving]))
        still = []
        for m, row in zip(moving, sums, strict=True):
            part, c = training[m["fold"]], grid[m["place"]]
            w = m["x"][:cut]
            gradient = row[1:] / part.total
            gradient[:cut] += w / (c * part.total)
            value = row[0] / part.total + float(w @ w) / (2 * c * part.total)
            size_now = float(np.abs(gradient).max())
            m["first"] = m["first"] or max(size_now, 1e-300)
            if m["next"] and size_now <= NEAR * m["first"]:
                m["next"] = False
                still.append(begin(m["fold"], m["place"] + 1, m["x"].copy()))
            try:
                m["x"] = m["steps"].send((value, gradient))
                still.append(m)
            except StopIteration as end:
                done[c][m["fold"]] = _head(classes, end.value, part, dim)
                if m["next"]:
                    still.append(begin(m["fold"], m["place"] + 1, end.value.copy()))
        moving = still
    return done


def _head(classes: Sequence[str], x: np.ndarray, part: Training, dim: int) -> Head:
    """Absent classes are zero; the bias, which is free up to a constant, has mean zero over the others."""
    kinds, present = len(classes), part.weight > 0
    w, b = x[:kinds * dim].reshape(kinds, dim).copy(), x[kinds * dim:].copy()
    w[~present], b[~present] = 0.0, 0.0
    b[present] -= b[present].mean()
    return Head(tuple(classes), w, b)


def loss_by_strength(pool: DataFrame, calib: DataFrame | None, heads: dict[float, dict[int, Head]], vector: str = "e", label: str = "class_idx",
                     fold: str = "fold") -> DataFrame:
    """(i, c, n, nll): mean loss of every strength over the pool rows, each by the head of its own fold, and the calibration rows by the
    mean logits of the fold heads. One pass; a batch sends one sum per strength."""
    grid = list(heads)
    pick = [F.col(vector).alias("e"), F.col(label).cast("int").alias("y")]
    rows = pool.select(*pick, F.col(fold).cast("int").alias("fold"))
    if calib is not None:
        rows = rows.unionByName(calib.select(*pick, F.lit(EVERY_ROW).alias("fold")))
    shared = rows.sparkSession.sparkContext.broadcast([{f: (h.weights, h.bias) for f, h in heads[c].items()} for c in grid])

    def partial(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            e, y, of = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            sums = []
            for by_fold in shared.value:
                total = 0.0
                for f in np.unique(of):
                    at = of == f
                    used = [by_fold[f]] if f >= 0 else list(by_fold.values())
                    z = sum(e[at] @ w.T + bias for w, bias in used) / len(used)
                    peak = z.max(axis=1)
                    total += float((peak + np.log(np.exp(z - peak[:, None]).sum(axis=1)) - z[np.arange(len(z)), y[at]]).sum())
                sums.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(np.full(len(grid), len(y))), pa.array(sums)],
                                             names=["i", "n", "s"])

    per = rows.mapInArrow(partial, "i int, n bigint, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return per.select("i", F.get(F.array(*[F.lit(float(c)) for c in grid]), F.col("i")).alias("c"), "n", (F.col("s") / F.col("n")).alias("nll"))


def select_c(train: DataFrame, grid: Sequence[float], classes: Sequence[str], fold: str = "fold", label: str = "class_idx", vector: str = "e") -> DataFrame:
    """(c, nll, chosen): mean out-of-fold loss for each strength; the lowest wins, the first on ties. All folds and strengths are fitted at once."""
    folds = sorted(r[0] for r in train.select(F.col(fold).cast("int")).distinct().collect())  # one row per fold
    per = loss_by_strength(train, None, fit_heads(train, grid, classes, folds, vector, label, fold), vector, label, fold)
    best = per.agg(F.min_by("i", F.struct("nll", "i")).alias("best"))
    return per.join(F.broadcast(best)).select("c", "nll", (F.col("i") == F.col("best")).alias("chosen"))
