"""Spreadsheet date functions as Columns. Dates are serial day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.numeric import UNSUPPORTED, VALUE_ERROR
from tablescope.functions.values import canon_str

# Day zero of the serial calendar and the formats TEXT knows.
EPOCH = "1899-12-30"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
TEXT_FORMATS = ("0", "0.00", "yyyy-mm-dd")

_MONDAY = "1900-01-01"
_NUMBER_TYPES = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def _epoch() -> Column:
    return F.lit(EPOCH).cast("date")


def as_date(x: Column) -> Column:
    """Date from a serial number, a date/timestamp or ISO text; NULL otherwise."""
    kind, text = F.typeof(x), x.cast("string")
    serial = F.date_add(_epoch(), F.floor(text.try_cast("double")).try_cast("int"))
    return (
        F.when(kind.rlike(_NUMBER_TYPES), serial)
        .when(kind == "string", F.when(text.rlike(ISO_DATE), text.try_cast("date")))
        .when(kind.isin("date", "timestamp", "timestamp_ntz"), F.substring(text, 1, 10).try_cast("date"))
    )


def serial(d: Column) -> Column:
    """Serial number of a DATE column."""
    return F.date_diff(d, _epoch()).cast("bigint")


def _value_error(result: Column) -> Column:
    return F.when(result.isNull(), F.lit(VALUE_ERROR))


def _int(x: Column) -> Column:
    return x.try_cast("double").try_cast("int")


def date_(year: Column, month: Column, day: Column) -> Column:
    """Months and days outside their range roll over."""
    first = F.make_date(_int(year), F.lit(1), F.lit(1))
    return serial(F.date_add(F.add_months(first, _int(month) - 1), _int(day) - 1))


def date_err(year: Column, month: Column, day: Column) -> Column:
    return _value_error(_int(year) + _int(month) + _int(day))


def datevalue(x: Column) -> Column:
    return serial(as_date(x))


def year_(x: Column) -> Column:
    return F.year(as_date(x)).cast("bigint")


def month_(x: Column) -> Column:
    return F.month(as_date(x)).cast("bigint")


def day_(x: Column) -> Column:
    return F.dayofmonth(as_date(x)).cast("bigint")


def datevalue_err(x: Column) -> Column:
    return _value_error(as_date(x))


def edate(x: Column, months: Column) -> Column:
    """Month shift that overflows: 31 January + 1 month is 3 March."""
    d = as_date(x)
    month_start = F.trunc(F.add_months(d, _int(months)), "MM")
    return serial(F.date_add(month_start, F.dayofmonth(d) - 1))


def eomonth(x: Column, months: Column) -> Column:
    return serial(F.last_day(F.add_months(as_date(x), _int(months))))


def shift_err(x: Column, months: Column) -> Column:
    return _value_error(F.when(as_date(x).isNotNull(), _int(months)))


def _weekdays_through(d: Column) -> Column:
    days = F.date_diff(d, F.lit(_MONDAY).cast("date")).cast("bigint")
    weeks = F.floor(days / F.lit(7)).cast("bigint")
    return weeks * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5).cast("bigint"))


def networkdays(start: Column, end: Column) -> Column:
    """Monday to Friday, both ends included, negative if reversed; closed form."""
    a, b = as_date(start), as_date(end)
    forward = _weekdays_through(b) - _weekdays_through(F.date_sub(a, 1))
    backward = _weekdays_through(F.date_sub(b, 1)) - _weekdays_through(a)
    return F.when(a <= b, forward).otherwise(backward)


def networkdays_err(start: Column, end: Column) -> Column:
    return F.when(as_date(start).isNull() | as_date(end).isNull(), F.lit(VALUE_ERROR))


def text_(x: Column, fmt: str) -> Column:
    """Only the formats in TEXT_FORMATS; anything else is NULL with an error code."""
    if fmt in ("0", "0.00"):
        from tablescope.functions.numeric import round_

        value = F.when(canon_str(x) == "", F.lit(0.0)).otherwise(x.try_cast("double"))
        large = canon_str(value)  # no digits behind the point are left from 9e15 on
        if fmt == "0":
            out = F.when(F.abs(value) < F.lit(9e15), F.floor(value + F.lit(0.5)).cast("string")).otherwise(large)
        else:
            out = F.when(F.abs(value) < F.lit(9e15), F.format_string("%.2f", round_(value, 2))).when(
                F.abs(value) < F.lit(1e21), F.concat(large, F.lit(".00"))).otherwise(large)
        return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), out)
    if fmt == "yyyy-mm-dd":
        return F.date_format(as_date(x), "yyyy-MM-dd")
    return F.lit(None).cast("string")


def text_err(x: Column, fmt: str) -> Column:
    if fmt not in TEXT_FORMATS:
        return F.lit(UNSUPPORTED)
    return _value_error(text_(x, fmt))


def today() -> Column:
    """Volatile: one value per query, UTC."""
    return serial(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("date"))


def now() -> Column:
    seconds = F.unix_micros(F.current_timestamp()).cast("double") / F.lit(1e6)
    return seconds / F.lit(86400.0) + F.date_diff(F.lit("1970-01-01").cast("date"), _epoch())
