"""Rows worth dropping: duplicates, mostly empty rows, outlier candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import missing, row_key

# Reasons and actions.
STABLE, OUTLIER, EMPTY, DUPLICATE = "stable", "outlier_candidate", "high_missing_rate", "duplicate_row"
KEEP, DROP, KEPT = "keep", "drop_row", "keep_after_auto_drop"


def missing_ratio(df: DataFrame, cols: Sequence[str], count_row_id: bool = True) -> Column:
    """Share of missing cells in a row; by default the row id counts as one filled cell."""
    flags = F.lit(0)
    for c in cols:
        flags = flags + missing(df, c).cast("int")
    return flags / F.lit(float(len(cols) + (1 if count_row_id else 0)))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None, out: str = "_is_duplicate") -> DataFrame:
    """Flags every member of a group of equal rows.

    Copies are counted by row hash with map-side partial counts; only hashes seen twice or
    more are joined back, so a huge group of copies is never gathered in one place.
    """
    cols = list(cols or df.columns)
    keyed = df.withColumn("_key", row_key(df, cols))
    repeated = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return keyed.join(repeated, "_key", "left").withColumn(out, F.col("_n").isNotNull()).drop("_key", "_n")


def noise_columns(
    df: DataFrame, cols: Sequence[str], threshold: float = 0.5, mode: str = "preview", outlier: str | None = None,
    score: str | None = None, count_row_id: bool = True,
) -> DataFrame:
    """Noise columns from row rules, plus an optional outlier flag and score column.

    Later rules win: outlier, then mostly empty, then duplicate. ``auto`` drops candidates.
    """
    flagged = duplicate_rows(df, cols, "_dup")
    empty = missing_ratio(flagged, cols, count_row_id) >= F.lit(threshold)
    out = F.coalesce(F.col(outlier), F.lit(False)) if outlier else F.lit(False)
    drop = F.col("_dup") | empty
    reason = F.when(F.col("_dup"), F.lit(DUPLICATE)).when(empty, F.lit(EMPTY)).when(out, F.lit(OUTLIER))
    marked = flagged.withColumns({
        "_noise_score": F.col(score) if score else F.lit(0.0),
        "_is_noise_candidate": drop | out,
        "_noise_reason": reason.otherwise(F.lit(STABLE if outlier else "")),
        "_proposed_action": F.when(drop, F.lit(DROP)).otherwise(F.lit(KEEP)),
        "_applied_action": F.lit(KEPT if mode == "auto" else KEEP),
    }).drop("_dup")
    return marked.filter(~F.col("_is_noise_candidate")) if mode == "auto" else marked


def noise_metrics(all_rows: DataFrame, mode: str) -> DataFrame:
    """Counts over the rows before any drop."""
    kept = F.count_if(~F.col("_is_noise_candidate")) if mode == "auto" else F.count(F.lit(1))
    return all_rows.agg(
        F.count_if("_is_noise_candidate").alias("noise_candidate_count"), kept.alias("retained_count"), F.lit(mode).alias("apply_mode")
    )
