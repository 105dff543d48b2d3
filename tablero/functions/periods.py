"""Calendar helpers around an explicit reference date ``as_of``."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, functions as F


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def year_start(day: dt.date) -> dt.date:
    return day.replace(month=1, day=1)


def shift_months(day: dt.date, months: int) -> dt.date:
    """The same day ``months`` later, clamped to the end of the month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def shift_days(day: dt.date, days: int) -> dt.date:
    return day + dt.timedelta(days=days)


def day_of(moment: Column) -> Column:
    return F.to_date(moment)


def month_of(moment: Column) -> Column:
    return F.trunc(moment, "month")


def days_until(as_of: dt.date, moment: Column) -> Column:
    """Whole days from ``moment`` to ``as_of``."""
    return F.date_diff(F.lit(as_of), F.to_date(moment))


def within(moment: Column, since: dt.date | None, until: dt.date | None = None) -> Column:
    """Half-open range on the raw column, so that the bounds reach the Parquet scan."""
    condition = F.lit(True)
    if since is not None:
        condition = moment >= F.lit(since)
    if until is not None:
        upper = moment < F.lit(until)
        condition = upper if since is None else condition & upper
    return condition
