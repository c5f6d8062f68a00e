"""Report bundle: results, metrics, evaluation and formulas as four tables in one folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of the evaluation table, in this order.
EVALUATION_KEYS = ("overall_verdict", "signal_strength", "model_viability", "confidence", "risk_flags", "next_actions", "decision")
NOT_AVAILABLE = "evaluation_not_available"


def evaluation_table(evaluation: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(key, value); nested values as JSON text."""
    if evaluation is None:
        return spark.range(1).select(F.lit(NOT_AVAILABLE).alias("key"), F.lit("true").alias("value"))
    nested = ("risk_flags", "next_actions", "decision")
    cells = [
        F.struct(F.lit(k).alias("key"), (F.to_json(k, {"ignoreNullFields": "false"}) if k in nested else F.col(k).cast("string")).alias("value"))
        for k in EVALUATION_KEYS
    ]
    extra = [c for c in evaluation.columns if c == "target_column"]
    return evaluation.select(*extra, F.inline(F.array(*cells)))


def metrics_table(metrics: DataFrame, nested: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, value) of a metrics table; nested tables such as a confusion matrix as one JSON text each."""
    out = metrics.select(F.col("metric").alias("key"), F.col("value").cast("string").alias("value"))
    for name, table in (nested or {}).items():
        packed = table.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*table.columns)))).alias("value"))
        out = out.unionByName(packed.select(F.lit(name).alias("key"), "value"))
    return out


def formulas_table(formulas: DataFrame | None, workbook_id: str, active_sheet: str, spark: SparkSession) -> DataFrame:
    """One row per formula cell, or a single empty row."""
    columns = ["workbook_id", "sheet_name", "active_sheet", "address", "formula", "cached_value"]
    if formulas is None or formulas.isEmpty():
        null = F.lit(None).cast("string")
        values = [F.lit(workbook_id), F.lit(active_sheet), F.lit(active_sheet), null, null, null]
        return spark.range(1).select(*[v.alias(c) for v, c in zip(values, columns)])
    return formulas.select(
        F.lit(workbook_id).alias("workbook_id"), F.col("sheet").alias("sheet_name"), F.lit(active_sheet).alias("active_sheet"), "address", "formula", "cached_value"
    )


def export_bundle(
    path: str, results: DataFrame, metrics: DataFrame, evaluation: DataFrame | None = None, formulas: DataFrame | None = None,
    workbook_id: str = "", active_sheet: str = "", nested: dict[str, DataFrame] | None = None,
) -> dict[str, str]:
    spark = results.sparkSession
    tables = {
        "results": results, "metrics": metrics_table(metrics, nested), "evaluation": evaluation_table(evaluation, spark),
        "formulas": formulas_table(formulas, workbook_id, active_sheet, spark),
    }
    out = {}
    for name, table in tables.items():
        out[name] = os.path.join(path, name)
        table.write.mode("overwrite").parquet(out[name])
    return out
