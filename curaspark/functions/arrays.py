"""Array arithmetic in column expressions, in doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def peak_to_trough(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def centred(a: Column, about: str = "mean") -> Column:
    """An array less its mean or its median."""
    if about == "median":
        ordered, n = F.sort_array(a), F.size(a)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        return F.transform(a, lambda x: x - middle)
    m = mean(a)
    return F.transform(a, lambda x: x - m)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for an empty array or one without length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = norm(x) * norm(y)
    return F.when((n > 0) & (size > 1e-12), dot(x, y) / F.greatest(size, F.lit(1e-300))).otherwise(0.0)


def pearson(a: Column, b: Column, degenerate: float | None = None) -> Column:
    """Correlation of two arrays; `degenerate` is given for constant ones (None: NaN)."""
    x, y = centred(a), centred(b)
    size = norm(x) * norm(y)
    other = F.lit(float("nan") if degenerate is None else float(degenerate))
    return F.when(size > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(x, y) / F.greatest(size, F.lit(1e-300))))).otherwise(other)


SIMILARITIES = {"pearson": lambda a, b: pearson(a, b, -1.0), "cosine": cosine}


def rescaled(a: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Linear to [low, high]; the middle if constant."""
    least, span = F.array_min(a), peak_to_trough(a)
    return F.transform(a, lambda x: F.when(span > 0, low + (x - least) * (high - low) / F.greatest(span, F.lit(1e-300))).otherwise((low + high) / 2))


def extremes(a: Column) -> Column:
    """Least and greatest value with their first places, from 1."""
    low, high = F.array_min(a), F.array_max(a)
    return F.struct(low.alias("low"), F.array_position(a, low).alias("low_at"), high.alias("high"), F.array_position(a, high).alias("high_at"))


def padded(a: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), after))


def equal_bins(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of x among equal bins over [low, high], the last one closed; bin 0 if the range is empty."""
    place = F.floor((x - low) / F.when(high > low, high - low) * bins).cast("int")
    return F.coalesce(F.least(F.lit(bins - 1), place), F.lit(0))
