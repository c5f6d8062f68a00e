"""CHOOSE and DATEDIF as Columns; each has a companion with the error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.dates import as_date
from tablescope.functions.numeric import VALUE_ERROR

# Units of DATEDIF.
UNITS = ("Y", "M", "D", "MD", "YM", "YD")


def _place(index: Column) -> Column:
    return index.try_cast("double").try_cast("int")


def choose(index: Column, *values: Column) -> Column:
    """The value at ``index``, counted from 1 and cut to a whole number; NULL where there is none."""
    picked, at = F.lit(None), _place(index)
    for i, v in reversed(list(enumerate(values, 1))):
        picked = F.when(at == i, v).otherwise(picked)
    return picked


def choose_err(index: Column, *values: Column) -> Column:
    """``#VALUE!`` for an index that is no number or not between 1 and the number of values."""
    return F.when(~F.coalesce(_place(index).between(1, len(values)), F.lit(False)), F.lit(VALUE_ERROR))


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """Date of a day that may lie beyond its month's end: the 31st of February is a day in March."""
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def datedif(start: Column, end: Column, unit: str) -> Column:
    """Whole years (``Y``), months (``M``) or days (``D``) from ``start`` to ``end``.

    ``YM``: months beyond whole years; ``MD``: days beyond whole months; ``YD``: days beyond whole
    years. NULL where a date cannot be read, the end is before the start or the unit is unknown.
    """
    a, b, unit = as_date(start), as_date(end), unit.upper()
    if unit not in UNITS:
        return F.lit(None).cast("bigint")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.day(b) < F.day(a)).cast("int")
    if unit == "Y":
        out = F.floor(months / 12)
    elif unit == "M":
        out = months
    elif unit == "D":
        out = F.date_diff(b, a)
    elif unit == "YM":
        out = months % 12
    elif unit == "MD":
        before = F.add_months(F.trunc(b, "month"), -1)
        out = F.when(F.day(b) >= F.day(a), F.day(b) - F.day(a)).otherwise(F.date_diff(b, F.date_add(before, F.day(a) - 1)))
    else:
        out = F.date_diff(b, _rolled((F.year(a) + F.floor(months / 12)).cast("int"), F.month(a), F.day(a)))
    return F.when(b >= a, out.cast("bigint"))


def datedif_err(start: Column, end: Column, unit: str) -> Column:
    return F.when(datedif(start, end, unit).isNull(), F.lit(VALUE_ERROR))
