"""Exact decimal arithmetic: sums, averages, ratios and percentages.

Sums are decimal(25,2). Spark rounds a quotient to eleven decimals first, which can lift a value
to the half from below; ``ratio`` compares such a value with the exact product.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

SUM = "decimal(25,2)"
AVG2 = "decimal(15,2)"
AVG6 = "decimal(19,6)"
PCT = "decimal(15,2)"


def total(amount: Column) -> Column:
    """SUM of an amount; NULL when there is no row."""
    return F.sum(amount).cast(SUM)


def total_if(condition: Column, amount: Column) -> Column:
    """SUM of the amount over the rows that meet the condition, 0 for the others."""
    return total(F.when(condition, amount).otherwise(F.lit(0)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _nonzero(value: Column) -> Column:
    return F.when(value != F.lit(0), value)


def ratio(num: Column, den: Column, scale: int = 2, kind: str = AVG2) -> Column:
    """``num / den`` rounded half-up to ``scale`` decimals; NULL when the divisor is 0."""
    exact, divisor = num.cast("decimal(27,2)"), _nonzero(den.cast(SUM))
    quotient = exact / divisor
    up = F.round(quotient, scale)
    unit = F.lit(Decimal(1).scaleb(-scale))
    # A quotient that stands on the half may have been rounded there; at six decimals the
    # divisor is a count, so either product fits 38 digits.
    half = quotient.try_cast("decimal(27,3)" if scale == 2 else f"decimal(18,{scale + 1})")
    count = divisor if scale == 2 else divisor.cast("decimal(19,0)")
    lifted = ((quotient == half) & (F.abs(up - half) == F.lit(Decimal(5).scaleb(-scale - 1)))
              & (F.abs(exact) < F.abs(half * count)))
    down = up - F.when(quotient < 0, -unit).otherwise(unit)
    return F.when(lifted, down).otherwise(up).cast(kind)


def pct(num: Column, den: Column) -> Column:
    """100 · num / den with two decimals."""
    return ratio(num * F.lit(100), den, 2, PCT)


def mean(num: Column, n: Column) -> Column:
    """Average with two decimals."""
    return ratio(num, n, 2, AVG2)


def mean6(num: Column, n: Column) -> Column:
    """Average that is not rounded for display: six decimals."""
    return ratio(num, n, 6, AVG6)


def avg6(amount: Column) -> Column:
    return mean6(F.sum(amount), F.count(amount))


def avg2(amount: Column) -> Column:
    return mean(F.sum(amount), F.count(amount))


def commission(sales: Column, rate: Column) -> Column:
    """``rate`` percent of ``sales``, exact to six decimals."""
    return (sales.cast(SUM) * rate * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(31,6)")
