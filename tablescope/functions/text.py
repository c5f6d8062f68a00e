"""Spreadsheet text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.numeric import VALUE_ERROR
from tablescope.functions.values import canon_str


def concat_(*cols: Column) -> Column:
    return F.concat(*[canon_str(c) for c in cols])


def _whole(n: Column) -> Column:
    """Integer argument, NULL if it is not a whole number."""
    value = n.try_cast("double")
    return F.when(F.floor(value) == value, value.try_cast("int"))


def _size_error(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(VALUE_ERROR))


def left(s: Column, n: Column | None = None) -> Column:
    size = _whole(F.lit(1) if n is None else n)
    return F.when(size >= 0, F.substring(canon_str(s), F.lit(1), size))


def left_err(s: Column, n: Column | None = None) -> Column:
    return _size_error(_whole(F.lit(1) if n is None else n) < 0)


def right(s: Column, n: Column | None = None) -> Column:
    size = _whole(F.lit(1) if n is None else n)
    return F.when(size >= 0, F.right(canon_str(s), size))


right_err = left_err


def mid(s: Column, start: Column, n: Column) -> Column:
    begin, size = _whole(start), _whole(n)
    return F.when((begin >= 1) & (size >= 0), F.substring(canon_str(s), begin, size))


def mid_err(s: Column, start: Column, n: Column) -> Column:
    begin, size = _whole(start), _whole(n)
    return _size_error((begin < 1) | (size < 0))


def len_(s: Column) -> Column:
    return F.char_length(canon_str(s)).cast("bigint")


def trim_(s: Column) -> Column:
    return F.trim(F.regexp_replace(canon_str(s), r"\s+", " "))


def upper_(s: Column) -> Column:
    return F.upper(canon_str(s))


def lower_(s: Column) -> Column:
    return F.lower(canon_str(s))


def substitute(s: Column, old: Column, new: Column) -> Column:
    """Every occurrence; an empty ``old`` puts ``new`` between the characters."""
    text, find, put = canon_str(s), canon_str(old), canon_str(new)
    spread = F.array_join(F.transform(F.split(text, ""), lambda ch: ch), "\u0000")
    return F.when(find == "", F.replace(spread, F.lit("\u0000"), put)).otherwise(F.replace(text, find, put))
