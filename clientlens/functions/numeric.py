"""Numeric Column helpers (MTH-*). All JVM-side expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Money as an exact decimal so sums are order independent (MTH-01)."""
    return col_(c).cast(MONEY)


def rnd(c, n: int) -> Column:
    """ROUND half away from zero, stable across engines.

    The value is first fixed to 10 decimals as DECIMAL, then rounded, so a
    binary double such as 0.145 rounds the same way everywhere.
    """
    return F.round(col_(c).cast("decimal(38,10)"), n).cast("double")


def safe_divide(a, b) -> Column:
    """SAFE_DIVIDE: NULL when the divisor is 0 or NULL (MTH-06, AGG-06)."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def md5_bucket(c, buckets: int = 10) -> Column:
    """Deterministic bucket from the first 32 bits of md5(text) (MTH-07).

    Replaces FARM_FINGERPRINT for the train / test split; the same value
    is computable in SQL engines that expose md5.
    """
    h = F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def hash_uniform(c, salt: str = "") -> Column:
    """Reproducible U[0,1) from md5(id || salt), replacing RAND() (MTH-08).

    Partition- and retry-independent: a lost executor recomputes the same
    value, unlike ``rand()``.
    """
    h = F.conv(F.substring(F.md5(F.concat(col_(c).cast("string"), F.lit(salt))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def normal_cdf(z) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 26.2.17 polynomial.

    Absolute error < 7.5e-8; Spark SQL has no erf.
    """
    z = col_(z)
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (
        F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    pdf = F.exp(-x * x / 2.0) / F.lit(2.5066282746310002)
    upper = F.lit(1.0) - pdf * poly
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def bar_scale(c, max_abs) -> Column:
    """Bar width ``max(4, |x| / greatest(max|x|, 1) * 100)`` (PRJ-12)."""
    return F.greatest(F.lit(4.0), F.abs(col_(c)) / F.greatest(col_(max_abs), F.lit(1.0)) * 100.0)


def clamp_score(signal, base: float = 0.55, step: float = 0.1, cap: float = 0.95) -> Column:
    """``round(min(cap, base + step * signal), 2)`` (PRJ-07)."""
    return rnd(F.least(F.lit(cap), F.lit(base) + F.lit(step) * col_(signal).cast("double")), 2)
