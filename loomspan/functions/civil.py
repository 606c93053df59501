"""Civil dates without a year 0, as integers: never DateType, so any year of up to seven digits works."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_ordinal(year: Column) -> Column:
    """Years in a row: 1 before our era is 0; null for the year 0."""
    return F.when(year > 0, year).when(year < 0, year + 1)


def shifted_year(year: Column, by: Column) -> Column:
    """A year moved by a number of years, past the missing year 0."""
    at = year_ordinal(year) + by
    return F.when(at > 0, at).otherwise(at - 1)


def is_leap(year: Column) -> Column:
    y = year_ordinal(year)
    mod = lambda m: y - m * F.floor(y / m)
    return (mod(4) == 0) & ((mod(100) != 0) | (mod(400) == 0))


def month_length(year: Column, month: Column) -> Column:
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(is_leap(year), 29).otherwise(28)).when(month.between(1, 12), 31)


def is_valid(year: Column, month: Column, day: Column) -> Column:
    """Whether a date of year, month or day precision exists (missing parts are null)."""
    year_ok = (year != 0) & F.abs(year).between(1, 9_999_999)
    return F.coalesce(year_ok & (month.isNull() & day.isNull() | month.between(1, 12) & (day.isNull() | day.between(1, month_length(year, month)))), F.lit(False))


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days on the proleptic Gregorian axis; 0001-01-01 is 306, and the day before it 305."""
    y = year_ordinal(year) - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year).cast("long")


def label(year: Column) -> Column:
    """``N AEC`` or ``N EC``."""
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" AEC"))).otherwise(F.concat(year.cast("string"), F.lit(" EC")))


def partial_bounds(text: Column) -> tuple[Column, Column]:
    """First and last day of ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; null for anything else."""
    year = F.when(text.rlike(r"^\d{4}$"), text)
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), text)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    first = F.coalesce(F.concat(year, F.lit("-01-01")), F.concat(month, F.lit("-01")), day).try_cast("date")
    last = F.coalesce(F.concat(year, F.lit("-12-31")).try_cast("date"), F.last_day(F.concat(month, F.lit("-01")).try_cast("date")), day.try_cast("date"))
    return first, last


def _age(born: Column, at: Column) -> Column:
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - before.cast("int")


def calendar_age(born: Column, at: Column) -> Column:
    """Age in whole years from partial dates: one number, or ``min..max`` where they leave a choice; null if unborn or no date."""
    b0, b1 = partial_bounds(born)
    e0, e1 = partial_bounds(at)
    low, high = _age(b1, e0), _age(b0, e1)
    return F.when(low < 0, None).when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit(".."), high.cast("string")))
