"""Row tools: pages, previews, edits, chart series, column drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import column_kinds, finite, missing, numeric_of, present

MAX_PAGE = 1000


def blank_missing(df: DataFrame) -> DataFrame:
    """Every cell as text, missing cells as ""."""
    return df.select(*[F.coalesce(present(df, c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview(df: DataFrame, order_by: Sequence[str | Column], n: int = 10) -> DataFrame:
    """First ``n`` rows (top-n per task, then merged; no global sort)."""
    return blank_missing(df.orderBy(*order_by).limit(n))


def page(df: DataFrame, offset: int, limit: int = 100) -> DataFrame:
    """Rows offset+1 .. offset+limit by ``_row_id``; on a stored numbered table the range is pushed to the scan."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must be >= 0 and limit between 1 and {MAX_PAGE}")
    return blank_missing(df.filter(F.col("_row_id").between(offset + 1, offset + limit)))


def apply_edits(df: DataFrame, edits: DataFrame, key: str = "_row_id", sequence: str | None = None) -> DataFrame:
    """Replay an edit log of (key, op, column, value), in the order of ``sequence`` if the log has one.

    ops: ``set`` and ``clear`` change a cell, ``delete`` drops the row, ``insert`` adds a
    row of NULLs under a new key (cells set for that key fill it). Without ``sequence`` the log
    holds one set or clear per cell, and a delete wins.
    """
    if sequence:
        return _replayed(df, edits, key, sequence)
    cells = [c for c in df.columns if c != key]
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = edits.groupBy(key).agg(
        F.bool_or(F.col("op") == "delete").alias("_delete"),
        F.bool_or(F.col("op") == "insert").alias("_insert"),
        *[F.bool_or(F.col("op").isin("set", "clear") & (F.col("column") == c)).alias(f"_hit_{i}") for i, c in enumerate(cells)],
        *[F.max(F.when((F.col("op") == "set") & (F.col("column") == c), F.col("value"))).alias(f"_new_{i}") for i, c in enumerate(cells)],
    )
    base = df.withColumn("_old", F.lit(True))
    joined = base.join(changes, key, "full_outer")
    kept = joined.filter(
        ~F.coalesce(F.col("_delete"), F.lit(False)) & (F.col("_old").isNotNull() | F.coalesce(F.col("_insert"), F.lit(False)))
    )
    out = [F.col(key)]
    for i, c in enumerate(cells):
        hit = F.coalesce(F.col(f"_hit_{i}"), F.lit(False))
        out.append(F.when(hit, F.col(f"_new_{i}").try_cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c))
    return kept.select(*out)


def _replayed(df: DataFrame, edits: DataFrame, key: str, sequence: str) -> DataFrame:
    """The log compacted to the last writer of each cell and the last birth of each row.

    An edit of a row that is not there, and an insert of one that is, does nothing; a row that is
    inserted again after a delete begins with NULLs. Of edits with one number the larger value
    wins, a set before a clear. Rows with a third of all edits are folded in each task first.
    """
    cells = [c for c in df.columns if c != key]
    types = {f.name: f.dataType for f in df.schema.fields}
    at, op = F.col(f"`{sequence}`"), F.col("op")
    value = F.when(op == "set", F.col("value").cast("string"))
    last = [
        F.max(F.when(op.isin("set", "clear") & (F.col("column") == c), F.struct(at.alias("at"), (op == "set").alias("filled"), value.alias("value")))).alias(f"_last_{i}")
        for i, c in enumerate(cells)
    ]
    log = edits.groupBy(key).agg(F.max(F.when(op == "delete", at)).alias("_gone"), *last)
    inserts = edits.filter(op == "insert").select(key, at.alias("_at"))
    births = inserts.join(log.select(key, "_gone"), key).filter(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))).groupBy(key).agg(F.min("_at").alias("_born"))
    joined = df.withColumn("_old", F.lit(True)).join(log.join(births, key, "left"), key, "full_outer")
    kept_on = F.col("_old").isNotNull() & F.col("_gone").isNull()
    out = [F.col(key)]
    for i, c in enumerate(cells):
        hit = F.coalesce(F.col(f"_last_{i}").isNotNull() & (kept_on | (F.col(f"_last_{i}.at") > F.col("_born"))), F.lit(False))
        edited = F.col(f"_last_{i}.value").try_cast(types[c])
        out.append(F.when(hit, edited).when(kept_on, F.col(f"`{c}`")).alias(c))
    return joined.filter(kept_on | F.col("_born").isNotNull()).select(*out)


def add_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("string"))


def remove_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def view(df: DataFrame, where: Column | None = None, sort_by: Sequence[str | Column] = ()) -> DataFrame:
    """Filtered, sorted view."""
    out = df if where is None else df.filter(where)
    return out.orderBy(*sort_by) if sort_by else out


def chart_series(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    """(row, x, y) of the first two numeric columns; rows keep their number from ``_row_id``."""
    numeric, _ = column_kinds(df, [c for c in df.columns if c != "_row_id"])
    if x is None and not numeric:
        raise ValueError("chart needs a numeric column")
    x = x or numeric[0]
    y = y or (numeric[1] if len(numeric) > 1 else numeric[0])
    points = df.select(F.col("_row_id").alias("row"), numeric_of(df, x).alias("x"), numeric_of(df, y).alias("y"))
    return points.filter(finite(F.col("x")) & finite(F.col("y")))


def low_importance(importance: DataFrame, threshold: float = 0.2, keep: Sequence[str] = ()) -> DataFrame:
    """Features scoring at or below the threshold, label and id left out."""
    return importance.filter((F.col("score") <= threshold) & ~F.col("feature").isin(*keep))


def attach_result(source: DataFrame, result: DataFrame, defaults: dict[str, object], key: str = "_row_id") -> DataFrame:
    """Result columns looked up by row id; rows or fields without a result get the default."""
    extra = [c for c in defaults if c in result.columns]
    joined = source.drop(*[c for c in defaults if c in source.columns]).join(result.select(key, *extra), key, "left")
    for c, value in defaults.items():
        fill = F.lit(value)
        joined = joined.withColumn(c, F.coalesce(F.col(c), fill) if c in extra else fill)
    return joined


def require_min_rows(df: DataFrame, n: int, what: str) -> None:
    if df.limit(n).count() < n:
        raise ValueError(f"{what}: fewer than {n} rows are left once unusable ones are removed")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in cols:
        keep = keep & ~missing(df, c)
    return df.filter(keep)
