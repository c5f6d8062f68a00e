"""Random spreadsheet functions; every evaluation differs unless a seed is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.numeric import VALUE_ERROR
from tablescope.functions.values import finite


def rand_(seed: int | None = None) -> Column:
    return F.rand(seed)


def _bounds(low: Column, high: Column) -> tuple[Column, Column, Column]:
    lo = F.floor(low.try_cast("double")).cast("double")
    hi = F.floor(high.try_cast("double")).cast("double")
    return lo, hi, F.coalesce(finite(lo) & finite(hi) & (hi >= lo), F.lit(False))


def randbetween(low: Column, high: Column, seed: int | None = None, draw: Column | None = None) -> Column:
    lo, hi, ok = _bounds(low, high)
    u = F.rand(seed) if draw is None else draw
    return F.when(ok, F.floor(u * (hi - lo + 1)).cast("double") + lo)


def randbetween_err(low: Column, high: Column) -> Column:
    return F.when(~_bounds(low, high)[2], F.lit(VALUE_ERROR))
