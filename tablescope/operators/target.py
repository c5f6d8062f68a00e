"""Is a column a usable target, and what would a trivial predictor score?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import canon_str, numeric_of, present

# Limits and warning names.
NUMERIC_SHARE = 0.95
MIN_CLASS_ROWS = 5
MAX_TOP_SHARE = 0.9
MIN_STD = 1e-8


def target_kind(df: DataFrame, labels: Sequence[str], task: str = "auto") -> DataFrame:
    """regression if at least 95 % of all rows parse as numbers, else classification."""
    if task in ("classification", "regression"):
        kinds = [F.struct(F.lit(c).alias("target_column"), F.lit(task).alias("target_kind")) for c in labels]
        return df.limit(1).agg(F.count(F.lit(1))).select(F.inline(F.array(*kinds)))
    known = [c for c in labels if c in df.columns]
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(numeric_of(df, c)).alias(f"k{i}") for i, c in enumerate(known)]
    )
    cells = []
    for c in labels:
        if c in known:
            share = F.coalesce(F.try_divide(F.col(f"k{known.index(c)}"), F.col("n")), F.lit(0.0))
            kind = F.when(share >= NUMERIC_SHARE, F.lit("regression")).otherwise(F.lit("classification"))
        else:
            kind = F.lit("unknown")
        cells.append(F.struct(F.lit(c).alias("target_column"), kind.alias("target_kind")))
    return wide.select(F.inline(F.array(*cells)))


def missing_target(spark, label: str | None) -> DataFrame:
    """The single row returned for an absent label column."""
    return spark.range(1).select(
        F.lit(label).cast("string").alias("target_column"), F.lit("unknown").alias("target_kind"),
        F.lit("no_target").alias("feasibility"), F.array(F.lit("label_column_missing")).alias("warnings"),
    )


def class_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(target_column, class, n) over all candidate labels in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("target_column"), F.when(present(df, c).isNotNull(), canon_str(F.col(f"`{c}`"))).alias("class")) for c in labels])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*")
        .groupBy("target_column", "class").agg(F.count(F.lit(1)).alias("n"))
    )


def class_feasibility(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per candidate label; missing labels do not count."""
    filled = F.col("class").isNotNull()
    n = F.when(filled, F.col("n"))
    stats = class_counts(df, labels).groupBy("target_column").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.max(n).alias("top"), F.min(n).alias("low"), F.count_if(filled).alias("classes"),
    )
    empty = F.col("n") == 0
    share = F.try_divide(F.col("top"), F.col("n"))
    single = ~empty & (F.col("classes") <= 1)
    small = ~empty & (F.col("low") < MIN_CLASS_ROWS)
    uneven = ~empty & (share > MAX_TOP_SHARE)
    level = F.when(empty | single | small, F.lit("low")).when(uneven, F.lit("medium")).otherwise(F.lit("high"))
    warnings = F.array_compact(F.array(
        F.when(empty, F.lit("empty_target")), F.when(single, F.lit("single_class_target")),
        F.when(small, F.lit("minority_class_too_small")), F.when(uneven, F.lit("class_imbalance")),
    ))
    return stats.select(
        "target_column", F.lit("classification").alias("target_kind"), level.alias("feasibility"),
        share.alias("baseline_accuracy"), "classes", warnings.alias("warnings"),
    )


def regression_feasibility(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Error of always predicting the mean. Two passes: the means, then deviations from them."""
    values = df.select(*[numeric_of(df, c).alias(f"v{i}") for i, c in enumerate(labels)])
    means = values.agg(*[F.avg(f"v{i}").alias(f"a{i}") for i in range(len(labels))]).first()
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(labels)):
        away = F.col(f"v{i}") - F.lit(means[f"a{i}"]).cast("double")
        aggs += [F.count(f"v{i}").alias(f"k{i}"), F.avg(F.abs(away)).alias(f"e{i}"), F.sqrt(F.avg(away * away)).alias(f"s{i}")]
    cells = []
    for i, c in enumerate(labels):
        none = F.col(f"k{i}") == 0
        flat = ~none & (F.col(f"s{i}") <= MIN_STD)
        cells.append(F.struct(
            F.lit(c).alias("target_column"), F.lit("regression").alias("target_kind"),
            F.when(none | flat, F.lit("low")).otherwise(F.lit("high")).alias("feasibility"),
            F.col(f"e{i}").alias("baseline_mae"), F.col(f"s{i}").alias("baseline_rmse"),
            (F.lit(1.0) - F.try_divide(F.col(f"k{i}"), F.col("n"))).alias("missing_rate"),
            F.array_compact(F.array(F.when(none, F.lit("non_numeric_target")), F.when(flat, F.lit("near_constant_target")))).alias("warnings"),
        ))
    return values.agg(*aggs).select(F.inline(F.array(*cells)))
