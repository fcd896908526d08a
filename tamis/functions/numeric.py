"""Small numpy helpers used inside Arrow batches: list columns as matrices, log-gamma, incomplete beta by integration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as an (n, d) float64 matrix; every row must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if column.null_count or flat.size % n:
        raise ValueError("vectors must be present and of one length")
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    if (lengths != flat.size // n).any():
        raise ValueError("vectors must be of one length")
    return flat.reshape(n, -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """An (n, d) matrix as a list column of doubles."""
    n, d = values.shape
    offsets = np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size == 0, 1.0, size)


def softmax_rows(z: np.ndarray) -> np.ndarray:
    ex = np.exp(z - z.max(axis=1, keepdims=True))
    return ex / ex.sum(axis=1, keepdims=True)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Γ(x) for x > 0: shift above 10, then the Stirling series."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        if not low.any():
            break
        shift = np.where(low, shift + np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1.0, z)
    r = 1.0 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln Γ for x > 0: shift above 10, then the derivative of the Stirling series."""
    z, shift = _raised(x, lambda v: 1.0 / v)
    r = 1.0 / (z * z)
    return np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - shift


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of ln Γ for x > 0."""
    z, shift = _raised(x, lambda v: 1.0 / (v * v))
    r = 1.0 / (z * z)
    return 1.0 / z + r / 2 + r / z * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66)))) + shift


def _raised(x: np.ndarray, term) -> tuple[np.ndarray, np.ndarray]:
    """x raised by whole steps to 10 or more, and the sum of `term` over the steps left behind."""
    z = np.array(x, dtype=np.float64)
    total = np.zeros_like(z)
    for _ in range(10):
        low = z < 10
        total = total + np.where(low, term(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1.0, z)
    return z, total


_PANELS, _POINTS = 32, 16


def _log_density(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of t^a (1 - t)^b at logit(t) = ln(a / b) + d, less its value at d = 0, where it is largest. Written in d, so that nothing
    cancels for large a and b."""
    n = a + b
    low, high = np.minimum(d, 0.0), np.maximum(d, 0.0)
    return np.where(d < 0, a * low - n * np.log1p(a / n * np.expm1(low)), -b * high - n * np.log1p(b / n * np.expm1(-high)))


def _mass(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integral of the density from `low` to `high` by Gauss-Legendre points on equal panels."""
    at, weight = np.polynomial.legendre.leggauss(_POINTS)
    places = ((np.arange(_PANELS)[:, None] + (at + 1) / 2) / _PANELS).ravel()
    weights = np.tile(weight / (2 * _PANELS), _PANELS)
    width = np.maximum(high - low, 0.0)
    d = low[:, None] + width[:, None] * places
    return width * (np.exp(_log_density(d, a[:, None], b[:, None])) @ weights)


def beta_cdf(x: float | np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for arrays of positive a and b, to about 1e-12 for a + b up to 1e9 and beyond.

    On the logit scale the density is log-concave with its mode at ln(a / b); the mass on either side of x is integrated over the
    range that holds all but a negligible part, so the result needs no gamma function."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64))
    x = np.broadcast_to(np.asarray(x, dtype=np.float64), a.shape)
    flat_a, flat_b, flat_x = a.reshape(-1), b.reshape(-1), np.clip(x.reshape(-1), 1e-300, 1 - 1e-16)
    out = np.empty(len(flat_a))
    for first in range(0, len(out), 512):
        p, q, t = (v[first:first + 512] for v in (flat_a, flat_b, flat_x))
        sd = np.sqrt((p + q) / p / q)
        bottom, top = -(10 * sd + 40 / p), 10 * sd + 40 / q
        # t as a distance from the mode on the logit scale, without loss where it lies close
        mode = p / (p + q)
        far = t < mode / 2  # here the plain quotient loses nothing
        step = np.where(far, np.log(t / mode), np.log1p(np.where(far, 0.0, (t - mode) / mode))) - np.log1p(np.maximum((mode - t) / (1 - mode), -1 + 1e-16))
        cut = np.clip(step, bottom, top)
        below, above = _mass(bottom, cut, p, q), _mass(cut, top, p, q)
        out[first:first + 512] = below / (below + above)
    out = out.reshape(a.shape)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
