"""Measures of scalp maps as expressions over ARRAY<DOUBLE> columns; everything stays in the JVM.

Signed data are average-referenced first; positive data (`positive=True`) are not, and their field power is the root mean square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v) -> Column:
    return total(v) / F.size(v)


def average_reference(v) -> Column:
    """v less its own mean."""
    return F.zip_with(v, F.array_repeat(mean(v), F.size(v)), lambda x, m: x - m)


def reference_to(v, electrodes: list[int]) -> Column:
    """v less the mean of the listed electrodes (0-based)."""
    base = sum((F.element_at(v, e + 1) for e in electrodes[1:]), F.element_at(v, electrodes[0] + 1)) / len(electrodes)
    return F.zip_with(v, F.array_repeat(base, F.size(v)), lambda x, m: x - m)


def scale(v, factor) -> Column:
    return F.zip_with(v, F.array_repeat(factor, F.size(v)), lambda x, k: x * k)


def dot(u, v) -> Column:
    return total(F.zip_with(u, v, lambda a, b: a * b))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def rms(v) -> Column:
    return F.sqrt(dot(v, v) / F.size(v))


def gfp(v, positive: bool = False) -> Column:
    """Global field power: population standard deviation over electrodes; root mean square of positive data."""
    return rms(v) if positive else F.sqrt(F.greatest(F.lit(0.0), dot(v, v) / F.size(v) - mean(v) * mean(v)))


def correlation(u, v, positive: bool = False) -> Column:
    """Spatial correlation in [-1, 1]; null where a map is flat."""
    if positive:
        return dot(u, v) / F.nullif(norm(u) * norm(v), F.lit(0.0))
    n = F.size(u)
    above = dot(u, v) - total(u) * total(v) / n
    return above / F.nullif(F.sqrt(F.greatest(F.lit(0.0), (dot(u, u) - total(u) * total(u) / n) * (dot(v, v) - total(v) * total(v) / n))), F.lit(0.0))


def dissimilarity(u, v, positive: bool = False) -> Column:
    """0 for equal maps up to strength, 2 for inverted ones; correlation = 1 - dissimilarity^2 / 2."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * correlation(u, v, positive)))


def explained_variance(u, v) -> Column:
    return F.pow(correlation(u, v), 2)


def argmax(v) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def argmin(v) -> Column:
    return F.array_position(v, F.array_min(v)) - 1
