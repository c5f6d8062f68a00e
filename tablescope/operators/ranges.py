"""Ranges computed per row: a cell or a block of cells some rows and columns away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.numeric import REF_ERROR, VALUE_ERROR
from tablescope.functions.values import numeric_of
from tablescope.operators.lineage import BLOCK, SIZES, _pieces
from tablescope.operators.lookup import index_at
from tablescope.session import materialize

#: What can be computed over a range.
SUMMARIES = ("sum", "count", "min", "max", "average")


def _whole(x: Column) -> Column:
    """Number cut to a whole one; NULL for anything else."""
    return F.when(F.typeof(x) != "void", x.try_cast("double")).try_cast("bigint")


def offset_cell(df: DataFrame, table: DataFrame, row: Column, col: Column, rows: Column, cols: Column, out: str = "offset", position: str = "_row_id") -> DataFrame:
    """The table cell ``rows`` down and ``cols`` right of (row, col), counted from 1, as text.

    Numbers are cut to whole ones. Adds ``out`` and ``out_err``: ``#VALUE!`` where one of the four
    is no number, ``#REF!`` for a place outside the table.
    """
    return index_at(df, table, _whole(row) + _whole(rows), _whole(col) + _whole(cols), out, position)


def _blocks(table: DataFrame, position: str) -> tuple[DataFrame, int]:
    """(size, place, cells): count, sum, least and largest number of each column, for rows and for blocks of BLOCK ** size rows."""
    cells = [c for c in table.columns if c != position]

    def facts(x: Column) -> Column:
        return F.struct(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))

    rows = materialize(table.select((F.col(position).cast("bigint") - 1).alias("place"), *[numeric_of(table, c).alias(f"x{i}") for i, c in enumerate(cells)]))
    out = []
    for size in range(SIZES + 1):
        at = F.floor(F.col("place") / BLOCK**size).cast("bigint")
        # from the rows each time: partial aggregation leaves a row per block and task
        out.append(rows.groupBy(at.alias("place")).agg(F.array(*[facts(F.col(f"x{i}")) for i in range(len(cells))]).alias("cells")).withColumn("size", F.lit(size)))
    return materialize(reduce(DataFrame.unionByName, out)), len(cells)


def offset_range(
    df: DataFrame, table: DataFrame, key: str, row: Column, col: Column, rows: Column, cols: Column, height: Column, width: Column,
    how: str = "sum", out: str = "offset", position: str = "_row_id",
) -> DataFrame:
    """``how`` (of ``SUMMARIES``) over the ``height`` x ``width`` cells that begin ``rows`` down and ``cols`` right of (row, col).

    Only numbers count; a negative height or width extends up or to the left; cells beyond the
    table are blank. Adds ``out`` and ``out_err``: ``#VALUE!`` where an argument is no number,
    ``#REF!`` for a range of no size or one that begins above or left of the table. ``key`` is
    unique in ``df``. A range is read as a few blocks of rows whose sums are made once, so a long
    range costs no more than a short one, and no row of the table is repeated per range.
    """
    if how not in SUMMARIES:
        raise ValueError(f"how must be one of {SUMMARIES}")
    blocks, n_cols = _blocks(table, position)
    r, c, h, w = _whole(row) + _whole(rows), _whole(col) + _whole(cols), _whole(height), _whole(width)
    asked = materialize(df.select(F.col(key).alias("_k"), r.alias("_r"), c.alias("_c"), h.alias("_h"), w.alias("_w")))
    top, left = F.least("_r", F.col("_r") + F.col("_h") + 1), F.least("_c", F.col("_c") + F.col("_w") + 1)
    r1, c1 = F.when(F.col("_h") < 0, top).otherwise(F.col("_r")), F.when(F.col("_w") < 0, left).otherwise(F.col("_c"))
    known = F.col("_r").isNotNull() & F.col("_c").isNotNull() & F.col("_h").isNotNull() & F.col("_w").isNotNull()
    error = F.when(~known, F.lit(VALUE_ERROR)).when((F.col("_h") == 0) | (F.col("_w") == 0) | (r1 < 1) | (c1 < 1), F.lit(REF_ERROR))
    placed = asked.select("_k", r1.alias("r1"), c1.alias("c1"), F.abs("_h").alias("h"), F.abs("_w").alias("w"), error.alias("_err"))
    last = blocks.agg(F.max(F.when(F.col("size") == 0, F.col("place")))).first()[0]
    to = F.least(F.col("r1") + F.col("h") - 2, F.lit(-1 if last is None else last))
    inside = placed.filter(F.col("_err").isNull() & (F.col("r1") - 1 <= to) & (F.col("c1") <= n_cols))
    pieces = inside.select("_k", "c1", "w", F.explode(_pieces(F.col("r1") - 1, to)).alias("p")).select("_k", "c1", "w", "p.size", "p.place")
    met = pieces.join(blocks, ["size", "place"]).select("_k", F.explode(F.slice("cells", F.col("c1").cast("int"), F.least(F.col("w"), F.lit(n_cols)).cast("int"))).alias("x"))
    facts = met.groupBy("_k").agg(F.sum("x.n").alias("n"), F.sum("x.total").alias("total"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0.0))
    value = {"sum": total, "count": n.cast("double"), "min": F.coalesce("low", F.lit(0.0)), "max": F.coalesce("high", F.lit(0.0)),
             "average": F.coalesce(F.try_divide(total, n), F.lit(0.0))}[how]
    result = placed.join(facts, "_k", "left").select(F.col("_k").alias(key), F.when(F.col("_err").isNull(), value).alias(out), F.col("_err").alias(f"{out}_err"))
    return df.join(result, key)
