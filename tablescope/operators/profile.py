"""Column and sheet profiles: one aggregation, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import missing, present

# Limits and flag names, flags in this order.
HIGH_MISSING = 0.4
IDENTIFIER_RATIO = 0.9
IDENTIFIER_DISTINCT = 20
FLAGS = ("high_missing_rate", "low_variance", "likely_identifier")


def _wide(df: DataFrame, distinct: str | None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(missing(df, c)).alias(f"m{i}"))
        if distinct == "exact":
            aggs.append(F.count_distinct(present(df, c)).alias(f"d{i}"))
        elif distinct == "approx":
            aggs.append(F.approx_count_distinct(present(df, c), 0.01).alias(f"d{i}"))
    return df.agg(*aggs)


def _long(df: DataFrame, wide: DataFrame, distinct: bool) -> DataFrame:
    cells = []
    for i, field in enumerate(df.schema.fields):
        parts = [
            F.lit(i).alias("position"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("inferred_type"),
            F.col(f"m{i}").alias("missing_count"),
        ]
        if distinct:
            parts.append(F.col(f"d{i}").alias("unique_count"))
        cells.append(F.struct(*parts))
    return wide.select("n", F.inline(F.array(*cells)))


def sheet_profile(df: DataFrame) -> DataFrame:
    """row_count, column_count and the mean of the column missing rates."""
    rates = [F.coalesce(F.try_divide(F.col(f"m{i}"), F.col("n")), F.lit(0.0)) for i in range(len(df.columns))]
    total = rates[0]
    for r in rates[1:]:
        total = total + r
    return _wide(df, None).select(
        F.col("n").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        (total / F.lit(float(len(rates)))).alias("missing_rate_overall"),
    )


def column_info(df: DataFrame) -> DataFrame:
    return _long(df, _wide(df, None), False).select("position", "name", "inferred_type", "missing_count")


def data_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with rates and warning flags.

    Distinct counts are exact by default: Spark expands to (column, value) pairs and
    removes repeats before the shuffle. ``approx=True`` uses sketches and no value shuffle.
    """
    long = _long(df, _wide(df, "approx" if approx else "exact"), True)
    ratio = F.col("unique_count") / F.greatest(F.col("n"), F.lit(1))
    missing_rate = F.coalesce(F.try_divide(F.col("missing_count"), F.col("n")), F.lit(0.0))
    rated = long.withColumns({
        "missing_rate": missing_rate,
        "unique_ratio": ratio,
        "low_variance": F.col("unique_count") <= 1,
        "likely_identifier": (ratio > IDENTIFIER_RATIO) & (F.col("unique_count") >= IDENTIFIER_DISTINCT),
    })
    conditions = (F.col("missing_rate") >= HIGH_MISSING, F.col("low_variance"), F.col("likely_identifier"))
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in zip(conditions, FLAGS)]))
    return rated.withColumn("warning_flags", flags).select(
        "position", "name", "inferred_type", "missing_rate", "unique_count", "unique_ratio", "low_variance",
        "likely_identifier", "warning_flags", F.col("n").alias("row_count"),
    )
