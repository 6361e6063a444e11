"""Calendar periods labelled by their last day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_OF = {
    "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year",
    "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year",
}

# First day of the following period, as a step from the first day of this one.
STEP = {
    "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR",
}


def unit_name(freq: str) -> str:
    if freq not in UNIT_OF:
        raise ValueError(f"unknown time unit: {freq}")
    return UNIT_OF[freq]


def period_start(day: Column, freq: str) -> Column:
    unit = unit_name(freq)
    day = day.cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def end_of_period(start: Column, freq: str) -> Column:
    """Last day of the period that begins at `start`."""
    unit = unit_name(freq)
    if unit == "day":
        return start
    if unit == "week":
        return F.date_add(start, 6)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.date_sub(F.add_months(start, months), 1)


def period_end(day: Column, freq: str) -> Column:
    """Label of the period a date falls in (weeks end on Sunday)."""
    return end_of_period(period_start(day, freq), freq)


def parse_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Date from text; null where the text is no date."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def calendar(bounds: DataFrame, first: str, last: str, freq: str) -> DataFrame:
    """One row per period between two period starts, for each row of `bounds`."""
    unit = unit_name(freq)
    steps = F.sequence(F.col(first), F.col(last), F.expr(STEP[unit]))
    rest = [c for c in bounds.columns if c not in (first, last)]
    # `first` and `last` are null on an empty table: no periods then.
    return bounds.where(F.col(first).isNotNull()).select(*rest, F.explode(steps).alias("start"))
