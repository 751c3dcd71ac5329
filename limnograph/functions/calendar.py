"""Calendar columns and calendar predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month labels in calendar order.
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Fixed value: the field season, May to October.
FIELD_SEASON = tuple(range(5, 11))
#: Date ranges that a filter may consist of.
MOST_RANGES = 120


def month_abbr(date: Column) -> Column:
    return F.date_format(date, "MMM")


def month_full(date: Column) -> Column:
    return F.date_format(date, "MMMM")


def month_num(date: Column) -> Column:
    return F.month(date)


def year_num(date: Column) -> Column:
    return F.year(date)


def year_text(date: Column) -> Column:
    return F.date_format(date, "yyyy")


def mon_year(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def month_label(number: Column) -> Column:
    """Short label of a month number; cheaper than formatting a date per row."""
    return F.element_at(F.expr(f"array({', '.join(repr(m) for m in MONTH_ABBR)})"), number)


def month_axis(months: Iterable[int] = FIELD_SEASON) -> Column:
    """Array of (month_num, month) breaks from the first to the last month."""
    months = sorted(months)
    return F.transform(
        F.sequence(F.lit(months[0]), F.lit(months[-1])),
        lambda m: F.struct(m.alias("month_num"), month_label(m).alias("month")),
    )


def in_years(first: int | None, last: int | None, date: Column | str = "Date") -> Column:
    """Whole years ``first``..``last`` as a date range, which reaches the parquet scan."""
    date = F.col(date) if isinstance(date, str) else date
    condition = date.isNotNull()
    if first is not None:
        condition = condition & (date >= F.lit(dt.date(first, 1, 1)))
    if last is not None:
        condition = condition & (date < F.lit(dt.date(last + 1, 1, 1)))
    return condition


def in_months(months: Iterable[int], date: Column | str = "Date") -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return F.month(date).isin(*sorted(months))


def in_seasons(first: int, last: int, months: Iterable[int], date: Column | str = "Date") -> Column:
    """``months`` of the years ``first``..``last`` as date ranges, one per run of months and year, which reach the scan.

    Over ``MOST_RANGES`` ranges the years reach it as one range, and the months are looked at row by row.
    """
    date = F.col(date) if isinstance(date, str) else date
    months = sorted({m for m in months if 1 <= m <= 12})
    years = in_years(first, last, date)
    runs = [(m, next(n for n in range(m, 13) if n + 1 not in months)) for m in months if m - 1 not in months]
    if not months:
        return years & F.lit(False)
    if len(months) == 12:
        return years
    if len(runs) * (last - first + 1) > MOST_RANGES:
        return years & in_months(months, date)
    ranges = None
    for year in range(first, last + 1):
        for low, high in runs:
            stop = dt.date(year + (high == 12), high % 12 + 1, 1)
            one = (date >= F.lit(dt.date(year, low, 1))) & (date < F.lit(stop))
            ranges = one if ranges is None else ranges | one
    return years & ranges


def with_calendar(df: DataFrame, date: str = "Date") -> DataFrame:
    """Add ``month``, ``month_num`` and ``year``."""
    d = F.col(date)
    return df.withColumns(
        {"month": month_label(month_num(d)), "month_num": month_num(d), "year": year_num(d)}
    )
