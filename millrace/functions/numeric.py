"""Numeric column helpers shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, d: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(x, d) + F.lit(0.0)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logsigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """Stable on both ends: exp never sees a large positive argument."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    return x


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: sum of ``x`` where the mask holds over the number of such rows."""
    return F.sum(F.when(mask, x)) / F.count_if(mask)


def total_steps(n: Column, batch: int, epochs: int) -> Column:
    return F.floor(n / F.lit(batch)).cast("long") * F.lit(epochs)


def batch_count(n: Column, batch: int) -> Column:
    return F.ceil(n / F.lit(batch)).cast("long")


def progress_percent(step: Column, total: Column) -> Column:
    """Progress shown while running: never above 99."""
    return F.least(F.lit(99.0), F.try_divide(step.cast("double"), total.cast("double")) * F.lit(100.0))


def sql_softplus(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1.0 + exp(-abs({x}))))"


def sql_logsigmoid(x: str) -> str:
    return f"(least({x}, 0.0) - ln(1.0 + exp(-abs({x}))))"


def sql_sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def sql_rnd(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"
