"""Spreadsheet arithmetic, comparison, aggregate and logic functions as Columns.

Each value function yields NULL where a spreadsheet would show an error; the
``*_err`` companion yields the code.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.values import num

# Error codes shown in cells.
VALUE_ERROR = "#VALUE!"
REF_ERROR = "#REF!"
NA_ERROR = "#N/A"
UNSUPPORTED = "#UNSUPPORTED"
CIRCULAR = "#CIRC!"
PREDICT_ERROR = "#PREDICT_ERR"

_INF = float("inf")


def plus(a: Column, b: Column) -> Column:
    return num(a) + num(b)


def minus(a: Column, b: Column) -> Column:
    return num(a) - num(b)


def times(a: Column, b: Column) -> Column:
    return num(a) * num(b)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN, never an error."""
    x, y = num(a), num(b)
    return (
        F.when(y != 0, F.try_divide(x, y))
        .when(x > 0, F.lit(_INF))
        .when(x < 0, F.lit(-_INF))
        .otherwise(F.lit(float("nan")))
    )


def less(a: Column, b: Column) -> Column:
    return num(a) < num(b)


def less_equal(a: Column, b: Column) -> Column:
    return num(a) <= num(b)


def greater(a: Column, b: Column) -> Column:
    return num(a) > num(b)


def greater_equal(a: Column, b: Column) -> Column:
    return num(a) >= num(b)


def equal(a: Column, b: Column) -> Column:
    return num(a) == num(b)


def not_equal(a: Column, b: Column) -> Column:
    return num(a) != num(b)


def truthy(c: Column) -> Column:
    """False for NULL, NaN, 0, "" and false; everything else is true."""
    as_double = c.try_cast("double")
    by_number = as_double.isNotNull() & ~F.isnan(as_double) & (as_double != 0)
    return (
        F.when(c.isNull(), F.lit(False))
        .when(F.typeof(c) == "string", F.length(c.cast("string")) > 0)
        .otherwise(F.coalesce(by_number, F.lit(False)))
    )


def sum_(*cols: Column) -> Column:
    return reduce(add, [num(c) for c in cols], F.lit(0.0))


def average(*cols: Column) -> Column:
    """Blank and text cells count as 0 and stay in the denominator."""
    if not cols:
        return F.lit(None).cast("double")
    return sum_(*cols) / F.lit(float(len(cols)))


def min_(*cols: Column) -> Column:
    if not cols:
        return F.lit(None).cast("double")
    return F.least(*[num(c) for c in cols]) if len(cols) > 1 else num(cols[0])


def max_(*cols: Column) -> Column:
    if not cols:
        return F.lit(None).cast("double")
    return F.greatest(*[num(c) for c in cols]) if len(cols) > 1 else num(cols[0])


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def count_(*cols: Column) -> Column:
    """Non-blank cells, text included."""
    flags = [F.coalesce(_filled(c), F.lit(False)).cast("bigint") for c in cols]
    return reduce(add, flags, F.lit(0).cast("bigint"))


# The same functions over a column range: aggregates, to be used in ``agg``.
def sum_range(c: Column) -> Column:
    return F.sum(num(c))


def average_range(c: Column) -> Column:
    return F.avg(num(c))


def min_range(c: Column) -> Column:
    return F.min(num(c))


def max_range(c: Column) -> Column:
    return F.max(num(c))


def count_range(c: Column) -> Column:
    return F.count_if(F.coalesce(_filled(c), F.lit(False)))


def and_range(c: Column) -> Column:
    return F.bool_and(truthy(c))


def or_range(c: Column) -> Column:
    return F.bool_or(truthy(c))


def if_(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    branch = F.when(truthy(condition), then)
    return branch if otherwise is None else branch.otherwise(otherwise)


def and_(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [truthy(c) for c in cols], F.lit(True))


def or_(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [truthy(c) for c in cols], F.lit(False))


def not_(c: Column) -> Column:
    return ~truthy(c)


def abs_(c: Column) -> Column:
    return F.abs(num(c))


def round_(c: Column, digits: int = 0) -> Column:
    """Half away from zero on the exact binary value, so 1.005 to 2 digits is 1.0.

    The product x*10^d is rounded in floating point; splitting x in two halves gives
    the part lost (error-free product), which decides values that look like ties.
    From 9e15 on the product has no digits behind the point, and x stays as it is.
    """
    if not 0 <= digits <= 300:
        raise ValueError("digits must be between 0 and 300")
    x = num(c)
    size = F.abs(x)
    scale = F.lit(float(10**digits))
    scaled = size * scale
    wide = size * F.lit(134217729.0)  # 2^27 + 1
    high = wide - (wide - size)
    power = float(10**digits)
    top = 134217729.0 * power - (134217729.0 * power - power) if digits < 280 else power
    low = power - top
    lost = ((high * top - scaled) + high * low + (size - high) * top) + (size - high) * low
    whole = F.floor(scaled).cast("double")
    up = ((scaled - whole) - F.lit(0.5)) + lost >= 0
    rounded = F.when(up, whole + F.lit(1.0)).otherwise(whole) / scale
    return F.when(scaled >= F.lit(9.0e15), x).when(x < 0, -rounded).otherwise(rounded)
