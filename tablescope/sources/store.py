"""Stored metadata: formula catalogue, explorations, run log."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.lineage import extract_formulas

_FORMULAS = "sheet string, address string, formula string, cached_value string, workbook_id string"
_RUNS = "run_id string, kind string, status string, logged_at timestamp, request string, metadata string, result_path string"
_EXPLORATIONS = "saved_at timestamp, profile string, target string, sweep string, evaluation string, workbook_id string, sheet_name string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def save_formulas(cells: DataFrame, workbook_id: str, path: str) -> None:
    """Replace the formula cells of one workbook."""
    cached = F.col("value") if "value" in cells.columns else F.lit(None).cast("string")
    made = extract_formulas(cells.withColumn("_cached", F.when(~cached.startswith("="), cached))).select(
        "sheet", "address", "formula", F.col("_cached").alias("cached_value"), F.lit(workbook_id).alias("workbook_id")
    )
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workbook_id").parquet(path)


def load_formulas(spark: SparkSession, workbook_id: str, path: str, cells: DataFrame | None = None) -> DataFrame:
    """Formula cells of one workbook (only its partition is read); made from ``cells`` if absent."""
    found = _read(spark, path, _FORMULAS).filter(F.col("workbook_id") == workbook_id)
    if cells is not None and found.isEmpty():
        save_formulas(cells, workbook_id, path)
        return _read(spark, path, _FORMULAS).filter(F.col("workbook_id") == workbook_id)
    return found


def save_exploration(exploration, workbook_id: str, sheet_name: str, path: str) -> None:
    """Latest Explore result per workbook and sheet; a handful of small rows as JSON."""
    spark = exploration.evaluation.sparkSession
    texts = [json.dumps([json.loads(t) for t in d.toJSON().collect()]) for d in (exploration.profile, exploration.sweep, exploration.evaluation)]
    row = (datetime.now(timezone.utc), texts[0], json.dumps(exploration.target), texts[1], texts[2], workbook_id, sheet_name)
    spark.createDataFrame([row], _EXPLORATIONS).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "workbook_id", "sheet_name"
    ).parquet(path)


def load_exploration(spark: SparkSession, workbook_id: str, sheet_name: str, path: str) -> dict[str, Any] | None:
    row = _read(spark, path, _EXPLORATIONS).filter((F.col("workbook_id") == workbook_id) & (F.col("sheet_name") == sheet_name)).first()
    if row is None:
        return None
    return {"profile": json.loads(row["profile"]), "target": json.loads(row["target"]), "sweep": json.loads(row["sweep"]), "evaluation": json.loads(row["evaluation"])[0]}


def log_run(spark: SparkSession, path: str, run_id: str, kind: str, status: str, request: dict, metadata: dict, result_path: str | None = None) -> None:
    row = (run_id, kind, status, datetime.now(timezone.utc), json.dumps(request, default=str), json.dumps(metadata, default=str), result_path)
    spark.createDataFrame([row], _RUNS).coalesce(1).write.mode("append").parquet(path)


def find_run(spark: SparkSession, path: str, run_id: str) -> dict[str, Any] | None:
    """Latest state of a run."""
    row = _read(spark, path, _RUNS).filter(F.col("run_id") == run_id).orderBy(F.col("logged_at").desc()).first()
    return row.asDict() if row else None
