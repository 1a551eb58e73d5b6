"""Column functions of the numeric kernels: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DECIMALS = 6


def or_one(sd: Column) -> Column:
    """A standard deviation, or 1 where it is 0."""
    return F.when(sd == 0, 1.0).otherwise(sd)


def decimal_places(v: Column) -> Column:
    """Least number of decimals, up to six, that show v to within max(|v|, 1) * 1e-9; 0 for non-finite v."""
    eps = F.greatest(F.abs(v) * 1e-9, F.lit(1e-9))
    out = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0)
    for d in range(MAX_DECIMALS):
        out = out.when(F.abs(round_to(v, d) - v) <= eps, d)
    return out.otherwise(MAX_DECIMALS)


def round_to(v: Column, decimals: int) -> Column:
    """Half away from zero."""
    scale = 10.0**decimals
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def trust_label(trust: Column, ood: Column) -> Column:
    return F.when(trust.isNull(), None).when(ood | (trust < 0.34), "low trust").when(trust < 0.67, "check").otherwise("trusted")


def argmax(values: Column) -> Column:
    """0-based place of the largest element, the first on ties, NaN ignored; 0 for an empty array."""
    real = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(values.isNull(), None).otherwise(F.coalesce(F.nullif(F.array_position(values, F.array_max(real)), F.lit(0)) - 1, F.lit(0))).cast("int")


def confidence(values: Column) -> Column:
    """Largest element, NaN ignored; minus infinity for an empty array."""
    real = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(values.isNull(), None).otherwise(F.coalesce(F.array_max(real), F.lit(float("-inf"))))


def quantile(values: Column, q: float) -> Column:
    """Exact quantile with linear interpolation at q * (n - 1); 0 without values. Its state holds a group's distinct values."""
    return F.coalesce(F.percentile(values, q), F.lit(0.0))
