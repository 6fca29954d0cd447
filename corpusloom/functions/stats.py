"""Closed-form statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
#: Least kappa of each verbal band.
KAPPA_BANDS = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval in percent, clamped to 0..100; both ends are null where n is 0 or null."""
    p = k / n
    mid, half, denom = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), 100 * (mid - half) / denom), F.least(F.lit(100.0), 100 * (mid + half) / denom)
    return F.when(n > 0, low), F.when(n > 0, high)


def percent(k: Column, n: Column) -> Column:
    """100 k / n, null where n is 0 or null."""
    return F.when(n > 0, 100.0 * k / n)


def kappa(yy: Column, nn: Column, yn: Column, ny: Column) -> Column:
    """Cohen's kappa of a 2x2 table of counts; null if empty or if chance agreement is 1."""
    n = (yy + nn + yn + ny).cast("double")
    po = (yy + nn) / n
    pe = ((yy + yn) * (yy + ny) + (nn + ny) * (nn + yn)) / (n * n)
    return F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe))


def kappa_band(k: Column) -> Column:
    """Verbal band of a kappa value."""
    c = F.when(k.isNull(), F.lit(None).cast("string"))
    for floor, name in KAPPA_BANDS:
        c = c.when(k >= floor, name)
    return c.otherwise("poor")


def band(score: Column, bands: list[tuple[float, float]]) -> Column:
    """Label ``lo-hi`` of the half-open band [lo, hi) that holds the score; null outside of all bands."""
    c = F.lit(None).cast("string")
    for lo, hi in bands:
        c = F.when((score >= lo) & (score < hi), f"{lo:.2f}-{hi:.2f}").otherwise(c)
    return c


def progress(done: int, total: int, seconds: float) -> dict:
    """Rows done and in all, rows a second and the seconds left at that rate (None before the first row)."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "per_second": rate, "seconds_left": (total - done) / rate if rate > 0 else None}
