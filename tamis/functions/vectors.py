"""Vector expressions on ARRAY columns. All run in the JVM and compose with any projection or filter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalise(v: Column, floor: float | None = None) -> Column:
    """v / |v|. A zero vector stays zero, or is divided by `floor` when one is given."""
    size = F.greatest(norm(v), F.lit(floor)) if floor else F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return let(size, lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    scale = F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.coalesce(dot(a, b) / scale, F.lit(0.0))


def linear_scores(e: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One score per class for a head given as literals; wide vectors should use operators.scoring instead."""
    rows = [F.lit([float(x) for x in w]) for w in weights]
    return F.array(*[dot(row, e) + F.lit(float(b)) for row, b in zip(rows, bias, strict=True)])


def softmax_t(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    peak = F.array_max(z)
    shifted = let(peak, lambda m: F.transform(z, lambda x: F.exp((x - m) / t)))
    return let(shifted, lambda ex: let(total(ex), lambda s: F.transform(ex, lambda x: x / s)))


def argmax(p: Column) -> Column:
    """Zero-based index of the largest entry, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def log_loss(z: Column, y: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(z, lambda x: x / t)
    lse = let(F.array_max(scaled), lambda m: F.log(total(F.transform(scaled, lambda x: F.exp(x - m)))) + m)
    return lse - F.get(scaled, y)


def standardise(e: Column, mean: Column, sd: Column) -> Column:
    centred = F.zip_with(e, mean, lambda x, m: x - m)
    return F.zip_with(centred, sd, lambda x, s: x / s)


def shift_logit(z: Column, index: int, amount: Column | float) -> Column:
    a = amount if isinstance(amount, Column) else F.lit(float(amount))
    return F.transform(z, lambda x, i: F.when(i == index, x + a).otherwise(x))


def forced_prediction(p: Column, routed: Sequence[int]) -> Column:
    """The best class that may be given as an answer: routed classes are set below every probability."""
    if not routed:
        return argmax(p)
    banned = F.array(*[F.lit(int(i)) for i in routed])
    return argmax(F.transform(p, lambda x, i: F.when(F.array_contains(banned, i), F.lit(-1.0)).otherwise(x)))


def quantise_scale(v: Column) -> Column:
    """Symmetric int8 scale of one row: max |x| / 127, kept above zero, stored as FLOAT."""
    return F.array_max(F.transform(v, lambda x: F.abs(x))) / F.lit(127.0) + F.lit(1e-12)


def quantise(v: Column) -> Column:
    """int8 row, rounded half to even."""
    return let(quantise_scale(v), lambda s: F.transform(v, lambda x: F.bround(x / s).cast("tinyint")))


def dequantise(q: Column, scale: Column) -> Column:
    return l2_normalise(F.transform(q, lambda x: x.cast("double") * scale.cast("double")))


def numeric_quality(v: Column, low: float = 0.12, high: float = 0.92, flat: float = 0.035) -> Column:
    """Mean, population sd and the first failed check of a numeric array."""
    n = F.size(v)
    mean = total(v) / n
    square = total(F.transform(v, lambda x: x * x)) / n

    def verdict(m: Column) -> Column:
        sd = F.sqrt(F.greatest(F.lit(0.0), square - m * m))
        reason = (F.when(m < low, "too dark").when(m > high, "too bright").when(sd < flat, "almost no detail"))
        return F.struct(m.alias("mean"), sd.alias("sd"), reason.alias("reason"))

    return let(mean, verdict)
