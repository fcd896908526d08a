"""Fits: multinomial head, refit pulled toward a head, heads from few local labels, and grids over them."""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import lists, matrix, softmax_rows
from tamis.operators.scoring import Head, score


STRENGTHS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


def fit_head(df: DataFrame, c: float, classes: Sequence[str], vector: str = "e", label: str = "class_idx",
             other_weight: float | None = None, tol: float = 1e-9, max_iter: int = 3000) -> Head:
    """Multinomial logistic regression with balanced class weights; the intercept is free, absent classes are zero."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    if not counts:
        raise ValueError("no training rows")
    n, present = sum(counts.values()), sorted(counts)
    weight = {k: n / (len(present) * m) for k, m in counts.items()}
    if other_weight is not None:
        weight[present[-1]] *= other_weight
    code = {k: i for i, k in enumerate(present)}
    pairs = [F.lit(x) for k in present for x in (k, float(weight[k]))]
    codes = [F.lit(x) for k in present for x in (k, float(code[k]))]
    rows = df.select(array_to_vector(vector).alias("features"), F.try_element_at(F.create_map(*codes), F.col(label)).alias("label"),
                     F.try_element_at(F.create_map(*pairs), F.col(label)).alias("w"))
    total = sum(weight[k] * m for k, m in counts.items())
    model = LogisticRegression(family="multinomial", weightCol="w", standardization=False, elasticNetParam=0.0,
                               regParam=1.0 / (c * total), tol=tol, maxIter=max_iter).fit(rows)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the fit has not converged in {max_iter} steps; raise max_iter or tol")
    found_w, found_b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    w, b = np.zeros((len(classes), found_w.shape[1])), np.zeros(len(classes))
    for k, i in code.items():
        w[k], b[k] = found_w[i], found_b[i]
    return Head(tuple(classes), w, b)


def descent(start: np.ndarray, tol: float = 1e-8, max_iter: int = 2000, memory: int = 12) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps with a backtracking line search, for smooth convex objectives: yields the point to evaluate next, is
    sent (value, gradient) and returns the minimum. It ends when the largest part of the gradient is below tol times the value (or tol),
    or when the value has stopped to change."""
    x = start.copy()
    value, grad = yield x
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    still = 0
    for _ in range(max_iter):
        if np.abs(grad).max() < tol * max(1.0, abs(value)) or still == 3:
            return x
        d, kept = -grad, []
        for s, y, rho in reversed(history):
            a = rho * (s @ d)
            kept.append(a)
            d = d - a * y
        if history:
            s, y, _ = history[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.sqrt(grad @ grad)))
        for (s, y, rho), a in zip(history, reversed(kept)):
            d = d + (a - rho * (y @ d)) * s
        slope = float(grad @ d)
        if slope >= 0:
            history, d = [], -grad
            slope = float(grad @ d)
        step = 1.0
        for _ in range(60):
            trial = x + step * d
            new_value, new_grad = yield trial
            if new_value <= value + 1e-4 * step * slope + 1e-15 * abs(value):
                break
            step *= 0.5
        else:
            return x  # no step lowers the value any more
        s, y = trial - x, new_grad - grad
        if s @ y > 1e-14 * float(np.sqrt((s @ s) * (y @ y))):
            history = [*history, (s, y, 1.0 / float(s @ y))][-memory:]
        still = still + 1 if abs(new_value - value) <= 1e-15 * abs(value) else 0
        x, value, grad = trial, new_value, new_grad
    raise RuntimeError(f"the fit has not converged in {max_iter} steps; raise max_iter or tol")


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tol: float = 1e-8,
             max_iter: int = 2000, memory: int = 12) -> np.ndarray:
    """The minimum of one objective by `descent`."""
    steps = descent(start, tol, max_iter, memory)
    point = next(steps)
    while True:
        try:
            point = steps.send(objective(point))
        except StopIteration as end:
            return end.value


def _loss_sums(e: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, t: float) -> tuple[float, np.ndarray, np.ndarray]:
    z = (e @ w.T + b) / t
    peak = z.max(axis=1, keepdims=True)
    lse = np.log(np.exp(z - peak).sum(axis=1)) + peak[:, 0]
    loss = float((lse - z[np.arange(len(y)), y]).sum())
    g = softmax_rows(z)
    g[np.arange(len(y)), y] -= 1.0
    g /= t
    return loss, g.T @ e, g.sum(axis=0)


def _pulled(start: Head, strength: float, sums: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]],
            n: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    shape = start.weights.shape
    cut = shape[0] * shape[1]

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:cut].reshape(shape), x[cut:]
        loss, gw, gb = sums(w, b)
        dw, db = w - start.weights, b - start.bias
        value = loss / n + strength / 2 * (float((dw * dw).sum()) + float((db * db).sum()))
        return value, np.r_[(gw / n + strength * dw).ravel(), gb / n + strength * db]

    return objective


def _refit(start: Head, x: np.ndarray, suffix: str) -> Head:
    cut = start.weights.size
    return start.with_settings(weights=x[:cut].reshape(start.weights.shape), bias=x[cut:], version=start.version + suffix)


def adapt_rows(start: Head, e: np.ndarray, y: np.ndarray, strength: float | None = None) -> Head:
    """The refit for a set of labels that fits in one task (a fixed number k of labels)."""
    lam = start.prior_strength if strength is None else strength
    if len(y) == 0:
        return start
    sums = lambda w, b: _loss_sums(e, y, w, b, start.temperature)
    x = minimise(_pulled(start, lam, sums, len(y)), np.r_[start.weights.ravel(), start.bias])
    return _refit(start, x, f"+local{len(y)}")


def adapt_head(start: Head, labelled: DataFrame, vector: str = "e", label: str = "class_idx",
               strength: float | None = None, tol: float = 1e-7, max_iter: int = 500) -> Head:
    """min mean CE((W e + b) / T) + strength/2 (|W - W0|^2 + |b - b0|^2) over a table of labels of any size.

    Each evaluation is one job: every task sums loss and gradient over its Arrow batches and sends one row; only classes
    x dimensions numbers reach the driver. Without labels the start head is returned.
    """
    lam = start.prior_strength if strength is None else strength
    rows = labelled.select(vector, F.col(label).cast("int").alias("y")).persist()
    try:
        n = rows.count()
        if n == 0:
            return start
        context = rows.sparkSession.sparkContext
        shape = start.weights.shape
        size = start.weights.size + len(start.bias)

        def sums(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            shared = context.broadcast((w, b, start.temperature))

            def partial(batches):
                w_, b_, t = shared.value
                out = np.zeros(size + 1)
                for batch in batches:
                    if batch.num_rows:
                        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(int)
                        loss, gw, gb = _loss_sums(matrix(batch.column(0)), y, w_, b_, t)
                        out += np.r_[loss, gw.ravel(), gb]
                yield pa.RecordBatch.from_arrays([lists(out[None, :])], names=["s"])

            parts = rows.mapInArrow(partial, "s array<double>").select(F.posexplode("s").alias("i", "x"))
            total = np.zeros(size + 1)
            for row in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row per head parameter
                total[row.i] = row.x
            shared.unpersist()
            return total[0], total[1:1 + start.weights.size].reshape(shape), total[1 + start.weights.size:]

        x = minimise(_pulled(start, lam, sums, n), np.r_[start.weights.ravel(), start.bias], tol, max_iter)
        return _refit(start, x, f"+local{n}")
    finally:
        rows.unpersist()


def local_only_rows(classes: Sequence[str], e: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Head from few local labels alone, balanced weights; None below two classes. Two classes share one coefficient row,
    split evenly with opposite signs; absent classes get a bias that never wins."""
    kinds, at = np.unique(y, return_inverse=True)
    if len(kinds) < 2:
        return None
    d = e.shape[1]
    weight = len(y) / (len(kinds) * np.bincount(at))[at]
    w, b = np.zeros((len(classes), d)), np.full(len(classes), -1e3)
    if len(kinds) == 2:
        sign = np.where(at == 1, 1.0, -1.0)

        def binary(x: np.ndarray) -> tuple[float, np.ndarray]:
            m = sign * (e @ x[:d] + x[d])
            loss = np.logaddexp(0.0, -m)
            g = -sign * weight * np.exp(-np.logaddexp(0.0, m))
            return float(weight @ loss) + x[:d] @ x[:d] / (2 * c), np.r_[e.T @ g + x[:d] / c, g.sum()]

        x = minimise(binary, np.zeros(d + 1))
        w[kinds[1]], b[kinds[1]] = x[:d] / 2, x[d] / 2
        w[kinds[0]], b[kinds[0]] = -x[:d] / 2, -x[d] / 2
        return w, b
    k = len(kinds)

    def multinomial(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, a = x[:k * d].reshape(k, d), x[k * d:]
        z = e @ v.T + a
        p = softmax_rows(z)
        loss = -np.log(np.maximum(p[np.arange(len(at)), at], 1e-300))
        p[np.arange(len(at)), at] -= 1.0
        p *= weight[:, None]
        return float(weight @ loss) + float((v * v).sum()) / (2 * c), np.r_[(p.T @ e + v / c).ravel(), p.sum(axis=0)]

    x = minimise(multinomial, np.zeros(k * d + k))
    w[kinds], b[kinds] = x[:k * d].reshape(k, d), x[k * d:]
    return w, b


def select_strength(train: DataFrame, check: DataFrame, start: Head, grid: Sequence[float], label: str = "class_idx",
                    vector: str = "e") -> DataFrame:
    """(strength, accuracy, chosen): accuracy of the refit on the check rows; the first maximum wins."""
    table = None
    for i, lam in enumerate(grid):
        head = adapt_head(start, train, vector, label, lam)
        row = score(check, head, vector=vector).agg(
            F.lit(i).alias("i"), F.lit(float(lam)).alias("strength"),
            F.avg((F.col("top") == F.col(label)).cast("double")).alias("accuracy"))
        table = row if table is None else table.unionByName(row)
    best = table.agg(F.max_by("i", F.struct("accuracy", -F.col("i"))).alias("best"))
    return table.join(F.broadcast(best)).select("strength", "accuracy", (F.col("i") == F.col("best")).alias("chosen"))
