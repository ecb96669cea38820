"""Months as YYYYMM integers and as linear month numbers, in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def month_no(period: Column) -> Column:
    """12 * year + month of a YYYYMM period."""
    return (_div(period, 100) * 12 + period % 100).cast("int")


def period_of(number: Column) -> Column:
    """YYYYMM of a linear month number."""
    t = number - 1
    return (_div(t, 12) * 100 + t % 12 + 1).cast("int")


def period_add(period: Column, months: Column | int) -> Column:
    return period_of(month_no(period) + months)


def period_diff(later: Column, earlier: Column) -> Column:
    """Whole months from `earlier` to `later`."""
    return month_no(later) - month_no(earlier)


def period_range(df: DataFrame, first: str, last: str, out: str = "period") -> DataFrame:
    """One row for each month from `first` to `last`, both included; none where last is earlier."""
    a, b = month_no(F.col(first)), month_no(F.col(last))
    months = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.explode(F.transform(months, period_of)))


def period_of_date(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def date_of_period(period: Column) -> Column:
    """First day of the month."""
    return F.make_date(_div(period, 100), period % 100, F.lit(1))


def date_int(date: Column) -> Column:
    """YYYYMMDD."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("int")


def is_month_end(date: Column) -> Column:
    return F.to_date(date) == F.last_day(date)


def is_year_end(date: Column) -> Column:
    return (F.month(date) == 12) & (F.day(date) == 31)


def quarter_label(period: Column) -> Column:
    """e.g. 2024Q3."""
    return F.concat(_div(period, 100).cast("string"), F.lit("Q"), (_div(period % 100 - 1, 3) + 1).cast("string"))


def year_label(period: Column) -> Column:
    return _div(period, 100).cast("string")


def account_key(kind: str, date: Column, number: Column) -> Column:
    """Padded key: kind, date, running number."""
    return F.format_string(f"{kind}%04d%02d%02d%04d", F.year(date), F.month(date), F.day(date), number.cast("int"))
