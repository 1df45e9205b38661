"""Column rules used by every layer: blanks, dates, rates and bands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(12,2)"  # one price or cost
# A sum of prices or a rate, as reported: wide enough that one extreme group, such
# as a customer with a third of all sales, cannot overflow and fail the report.
TOTAL = "decimal(38,2)"
MEAN = "decimal(38,6)"  # an average reported unrounded
_EXACT = "decimal(22,2)"  # operand of a division: leaves 12 digits for the quotient


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def unpadded(text: Column) -> Column:
    """Raw text as it compares: trailing blanks carry no meaning."""
    return F.rtrim(text)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (unknown counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start)


def hours_between(start: Column, end: Column) -> Column:
    """Full-hour marks crossed from ``start`` to ``end``."""
    return F.datediff(end, start) * 24 + F.hour(end) - F.hour(start)


def _quotient(numerator: Column, denominator: Column, factor: str) -> Column:
    divisor = F.nullif(denominator.cast(_EXACT), F.lit(0).cast(_EXACT))
    return numerator.cast(_EXACT) * F.lit(factor).cast("decimal(4,1)") / divisor


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return _quotient(part, whole, "100.0").cast(f"decimal(38,{digits})")


def ratio(amount: Column, count: Column) -> Column:
    """``amount`` per ``count``, to two decimals; NULL when ``count`` is zero."""
    return _quotient(amount, count, "1.0").cast(TOTAL)


def mean(total: Column, count: Column) -> Column:
    """An average from its sum and count, to six decimals."""
    return _quotient(total, count, "1.0").cast(MEAN)


def growth(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in percent of ``before``."""
    return percent(now - before, before)


def average(value: Column) -> Column:
    """Aggregate: mean of a whole number with its fraction, to six decimals."""
    return F.avg(value.cast(PRICE)).cast(MEAN)


# Customer age bands, as label and first age past the band.
AGE_BANDS = (("Under 25", 25), ("25-34", 35), ("35-44", 45), ("45-54", 55), ("55-64", 65))
OLDEST_AGES = "65+"

# Stock age bands in report order, as label and first day past the band.
STOCK_BANDS = (("Under 30 days", 30), ("30-89 days", 90), ("90-179 days", 180))
OLDEST_STOCK = "180+ days"
OLD_STOCK_DAYS = 180


def _band(value: Column, ends: Iterable[tuple[object, int]], last: object) -> Column:
    """The first entry whose end lies above ``value``, else ``last`` (also for NULL)."""
    result = F.lit(last)
    for entry, end in reversed(list(ends)):
        result = F.when(value < end, entry).otherwise(result)
    return result


def age_band(age: Column) -> Column:
    """Customer age band; an unknown age falls in the last one."""
    return _band(age, AGE_BANDS, OLDEST_AGES)


def stock_band(days: Column) -> tuple[Column, Column]:
    """Label and sort position of a stock age."""
    places = ((place, end) for place, (_, end) in enumerate(STOCK_BANDS, start=1))
    return _band(days, STOCK_BANDS, OLDEST_STOCK), _band(days, places, len(STOCK_BANDS) + 1)
