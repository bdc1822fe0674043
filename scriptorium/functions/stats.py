"""Closed forms of intervals and tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import two_sided_p

__all__ = ["log_log_interval", "two_sided_p", "wilson"]

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n, within 0 and 1; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(mid.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(mid.isNotNull(), F.least(F.lit(1.0), mid + half))


def log_log_interval(s: Column, greenwood: Column, z: float = 1.96, least: float = 1e-12) -> tuple[Column, Column]:
    """Bounds of a survival estimate on the log(-log) scale, from its cumulative Greenwood sum."""
    inside = F.least(F.greatest(s, F.lit(least)), F.lit(1 - least))
    spread = z * F.sqrt(greenwood) / F.abs(F.log(inside))
    center = F.log(-F.log(inside))
    return F.exp(-F.exp(center + spread)), F.exp(-F.exp(center - spread))
