"""A proleptic calendar of three integers.

Years may have five digits, which neither dates nor string order survive, so a day is year, month and day, and
its order is the ordinal year * 372 + month * 31 + day: injective and monotone, with gaps at month ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ORDINAL_PER_YEAR, DAYS_PER_MONTH, WEEK = 372, 31, 7
DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def floor_div(x: Column, n: int) -> Column:
    return F.floor(x / n)


def ordinal(year: Column, month: Column, day: Column) -> Column:
    return year * ORDINAL_PER_YEAR + month * DAYS_PER_MONTH + day


def split_date(date: Column) -> Column:
    """year, month and day of a Y-M-D string; parts that are no numbers are null."""
    part = lambda i: F.try_element_at(F.split(F.trim(date), "-"), F.lit(i)).try_cast("int")
    return F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"))


def join_date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def day_of_year(month: Column, day: Column) -> Column:
    """Day of a year of 365 days."""
    return F.element_at(F.array(*map(F.lit, DAYS_BEFORE_MONTH)), month.cast("int")) + day


def week_bucket(ordinal_: Column) -> Column:
    return floor_div(ordinal_, WEEK)


def month_of(ordinal_: Column) -> Column:
    """Month back from the ordinal; day 31 counts to the next month."""
    m = floor_div(ordinal_ % ORDINAL_PER_YEAR, DAYS_PER_MONTH)
    return F.when(m == 0, F.lit(12)).otherwise(m)


def month_of_raw(ordinal_: Column) -> Column:
    """The same without the correction for December, held to 0..11."""
    return F.least(F.greatest(floor_div(ordinal_ % ORDINAL_PER_YEAR, DAYS_PER_MONTH), F.lit(0)), F.lit(11))


def week_of_year(ordinal_: Column) -> Column:
    return week_bucket(ordinal_) % 52


def calendar_week(month: Column, day: Column) -> Column:
    """0 to 53."""
    return floor_div((month - 1) * DAYS_PER_MONTH + day, WEEK)


def future_month(month: Column, day: Column, weeks: int) -> Column:
    """Month after some weeks, in a year of twelve months of 31 days."""
    days = (month - 1) * DAYS_PER_MONTH + day + weeks * WEEK
    return floor_div(days - 1, DAYS_PER_MONTH) % 12 + 1


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * x / period
    return F.sin(angle), F.cos(angle)
