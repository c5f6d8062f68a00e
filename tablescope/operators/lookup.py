"""Spreadsheet lookups as joins: exact match on canonical text, first row wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.numeric import NA_ERROR, PREDICT_ERROR, REF_ERROR, UNSUPPORTED, VALUE_ERROR
from tablescope.functions.values import canon_str


def _first_per_key(table: DataFrame, key: Column, value: Column, order_by: Sequence[str]) -> DataFrame:
    """First value per key. Partial aggregation keeps one row per key and task before the shuffle."""
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    kept = F.struct(value.alias("v"))
    return table.select(canon_str(key).alias("_key"), kept.alias("_kept"), order.alias("_order")).groupBy("_key").agg(
        F.min_by("_kept", "_order").alias("_kept")
    )


def _probe(df: DataFrame, key: str | Column, firsts: DataFrame) -> DataFrame:
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    return df.withColumn("_probe", canon_str(key)).join(firsts, F.col("_probe") == F.col("_key"), "left")


def _failed(df: DataFrame, out: str, code: str) -> DataFrame:
    return df.withColumns({out: F.lit(None).cast("string"), f"{out}_err": F.lit(code)})


def vlookup(
    df: DataFrame, key: str | Column, table: DataFrame, col_index: float, order_by: Sequence[str],
    out: str = "vlookup", approximate: bool = False,
) -> DataFrame:
    """Adds ``out`` and ``out_err``. The first table column is the key; ``col_index`` counts from 1."""
    if approximate:
        return _failed(df, out, UNSUPPORTED)
    if col_index != int(col_index) or col_index < 1:
        return _failed(df, out, VALUE_ERROR)
    if col_index > len(table.columns):
        return _failed(df, out, REF_ERROR)
    value = F.col(f"`{table.columns[int(col_index) - 1]}`")
    firsts = _first_per_key(table, F.col(f"`{table.columns[0]}`"), value, order_by)
    found = _probe(df, key, firsts)
    return found.withColumns({
        out: F.col("_kept.v"), f"{out}_err": F.when(F.col("_key").isNull(), F.lit(NA_ERROR))
    }).drop("_probe", "_key", "_kept")


def xlookup(
    df: DataFrame, key: str | Column, table: DataFrame, lookup_col: str, return_col: str, order_by: Sequence[str],
    if_not_found: object = None, out: str = "xlookup", match_mode: int = 0,
) -> DataFrame:
    """Like vlookup with a separate return column and a value for "not found"."""
    if match_mode != 0:
        return _failed(df, out, UNSUPPORTED)
    firsts = _first_per_key(table, F.col(f"`{lookup_col}`"), F.col(f"`{return_col}`"), order_by)
    found = _probe(df, key, firsts)
    hit = F.col("_key").isNotNull()
    default = F.lit(if_not_found)
    value = F.when(hit, F.col("_kept.v")) if if_not_found is None else F.when(hit, F.col("_kept.v")).otherwise(default)
    error = F.when(hit & F.col("_kept.v").isNull(), F.lit(REF_ERROR))
    if if_not_found is None:
        error = F.when(~hit, F.lit(NA_ERROR)).otherwise(error)
    return found.withColumns({out: value, f"{out}_err": error}).drop("_probe", "_key", "_kept")


def match_position(
    df: DataFrame, key: str | Column, table: DataFrame, column: str, position: str = "_row_id",
    out: str = "match", match_type: int = 0,
) -> DataFrame:
    """1-based first position of the key in ``column``; ``position`` numbers the table's rows."""
    if match_type != 0:
        return _failed(df, out, UNSUPPORTED)
    firsts = table.groupBy(canon_str(F.col(f"`{column}`")).alias("_key")).agg(F.min(position).alias("_pos"))
    found = _probe(df, key, firsts)
    return found.withColumns({
        out: F.col("_pos").cast("bigint"), f"{out}_err": F.when(F.col("_key").isNull(), F.lit(NA_ERROR))
    }).drop("_probe", "_key", "_pos")


def index_at(df: DataFrame, table: DataFrame, row: Column, col: Column, out: str = "index", position: str = "_row_id") -> DataFrame:
    """The table cell at (row, col), both from 1, as text; ``position`` numbers the table's rows."""
    cells = [c for c in table.columns if c != position]
    packed = table.select(F.col(position).cast("bigint").alias("_pos"), F.array(*[F.col(f"`{c}`").cast("string") for c in cells]).alias("_cells"))
    r, c = row.try_cast("double"), col.try_cast("double")
    whole = F.coalesce((F.floor(r) == r) & (F.floor(c) == c), F.lit(False))
    placed = df.withColumns({"_r": F.when(whole, r.try_cast("bigint")), "_c": F.when(whole, c.try_cast("int"))})
    found = placed.join(packed, F.col("_r") == F.col("_pos"), "left")
    inside = F.col("_pos").isNotNull() & F.col("_c").between(1, len(cells))
    error = F.when(F.col("_r").isNull(), F.lit(VALUE_ERROR)).when(~inside, F.lit(REF_ERROR))
    value = F.when(inside, F.get(F.col("_cells"), F.col("_c") - 1))
    return found.withColumns({out: value, f"{out}_err": error}).drop("_r", "_c", "_pos", "_cells")


def predict_lookup(
    df: DataFrame, features: Sequence[str], result: DataFrame, prediction: str, order_by: Sequence[str] = ("_row_id",),
    out: str = "predict",
) -> DataFrame:
    """First stored prediction whose features all match as text."""
    sep = F.lit("\u0001")
    key = F.concat_ws("\u0001", *[canon_str(F.col(f"`{c}`")) for c in features], sep)
    firsts = _first_per_key(result, key, F.col(f"`{prediction}`"), order_by)
    found = _probe(df, key, firsts)
    return found.withColumns({
        out: F.col("_kept.v"), f"{out}_err": F.when(F.col("_key").isNull(), F.lit(PREDICT_ERROR))
    }).drop("_probe", "_key", "_kept")


def hlookup(
    df: DataFrame, key: str | Column, table: DataFrame, row_index: int | Column, out: str = "hlookup", position: str = "_row_id",
    lookup_row: int = 1, approximate: bool = False,
) -> DataFrame:
    """Adds ``out`` and ``out_err``: the cell in table row ``row_index`` of the first column whose cell in ``lookup_row`` matches the key.

    ``position`` numbers the table's rows from 1; rows are counted from ``lookup_row`` on, as a
    range that begins there. Cells compare as text and are given as text. ``#VALUE!`` for a row
    index below 1 or that is no number (it is cut to a whole one), ``#N/A`` for a key that is not
    there, ``#REF!`` for a row beyond the table. Only the lookup row, as wide as the table, is fetched.
    """
    if approximate:
        return _failed(df, out, UNSUPPORTED)
    cells = [c for c in table.columns if c != position]
    heads = table.filter(F.col(position) == lookup_row).select(*[canon_str(F.col(f"`{c}`")).alias(f"h{i}") for i, c in enumerate(cells)]).first()
    names = F.array(*[F.lit(h) for h in heads]) if heads else F.array().cast("array<string>")
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    wanted = F.lit(row_index) if isinstance(row_index, int) else row_index
    row = wanted.try_cast("double").try_cast("bigint")
    packed = table.select(F.col(position).cast("bigint").alias("_pos"), F.array(*[F.col(f"`{c}`").cast("string") for c in cells]).alias("_cells"))
    placed = df.withColumns({"_at": F.array_position(names, canon_str(key)).cast("int"), "_row": F.when(row >= 1, row)})
    found = placed.join(packed, F.col("_row") + (lookup_row - 1) == F.col("_pos"), "left")
    error = F.when(F.col("_row").isNull(), F.lit(VALUE_ERROR)).when(F.col("_at") == 0, F.lit(NA_ERROR)).when(F.col("_pos").isNull(), F.lit(REF_ERROR))
    value = F.when(error.isNull(), F.get(F.col("_cells"), F.col("_at") - 1))
    return found.withColumns({out: value, f"{out}_err": error}).drop("_at", "_row", "_pos", "_cells")
