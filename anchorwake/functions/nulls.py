"""Column helpers for missing-value rules that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that is missing where the condition is missing."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def sum_or_zero(x: Column) -> Column:
    """Sum of the present values, 0 when there are none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def strict_sum(x: Column, where: Column | None = None) -> Column:
    """Sum over the rows selected by ``where``; missing if any of them is missing."""
    chosen = F.lit(True) if where is None else where
    gaps = F.count_if(chosen & x.isNull())
    return F.when(gaps == 0, sum_or_zero(F.when(chosen, x)))


def strict_mean(x: Column) -> Column:
    """Mean that is missing if any value is missing."""
    return F.when(F.count_if(x.isNull()) == 0, F.avg(x))


def whole_number(x: Column) -> Column:
    """Text of the nearest whole number, halves to even."""
    return F.bround(x, 0).cast("bigint").cast("string")
