"""CSV and record sources, result sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_SHEET = "CSV Data"  # fixed value: sheet name of a CSV file
CSV_SHEET_ALIAS = "Sheet1"  # fixed value

# Texts read as missing in CSV files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred from all values.

    Missing texts become NULL before the types are chosen, so a column of numbers and
    "NA" stays numeric. With a schema the file is read once.
    """
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])).csv(path)
        return _blank_missing(text).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    text = _blank_missing(reader.csv(path))
    return text.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in infer_types(text).items()])


def _blank_missing(text: DataFrame) -> DataFrame:
    return text.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in text.columns])


def infer_types(text: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean, timestamp, string that fits every value; one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    kinds = ("bigint", "double", "boolean", "timestamp")
    for i, c in enumerate(text.columns):
        v = F.col(f"`{c}`")
        whole = v.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        number = v.try_cast("double").isNotNull() & ~v.rlike(r"[dDfF]\s*$")
        logic = F.lower(v).isin("true", "false")
        stamp = v.rlike(r"^\d{4}-\d{2}-\d{2}") & v.try_cast("timestamp").isNotNull()
        for kind, ok in zip(kinds, (whole, number, logic, stamp)):
            aggs.append(F.coalesce(F.bool_and(F.when(v.isNotNull(), ok)), F.lit(False)).alias(f"{kind}_{i}"))
        aggs.append(F.count(v).alias(f"k{i}"))
    row = text.agg(*aggs).first()
    out = {}
    for i, c in enumerate(text.columns):
        fits = [k for k in kinds if row[f"{k}_{i}"]]
        # whole numbers with gaps are kept as doubles, an empty column too
        if not row[f"k{i}"]:
            out[c] = "double"
        elif fits and fits[0] == "bigint" and row[f"k{i}"] < row["n"]:
            out[c] = "double"
        else:
            out[c] = fits[0] if fits else "string"
    return out


def rows_to_df(spark: SparkSession, rows: Sequence[dict], schema: str | None = None) -> DataFrame:
    """Request records as a table."""
    return spark.createDataFrame(list(rows), schema) if schema else spark.createDataFrame(list(rows))


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of JSON records as columns."""
    return df.select(*[c for c in df.columns if c != column], F.from_json(F.col(column), schema).alias("_r")).select(
        *[c for c in df.columns if c != column], "_r.*"
    )


def write_result(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> dict[str, str]:
    """Result in each format under ``path``; CSV gets a header."""
    out = {}
    for kind in formats:
        target = os.path.join(path, kind)
        writer = df.write.mode("overwrite")
        writer = writer.option("header", True) if kind == "csv" else writer
        getattr(writer, kind)(target)
        out[kind] = target
    return out


def load_source(spark: SparkSession, result_path: str | None, fallback: DataFrame) -> tuple[DataFrame, str]:
    """(table, source kind): a stored Prepare result if there is one, else the sheet."""
    if result_path:
        try:
            return spark.read.parquet(result_path), "prepare_job"
        except Exception as exc:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    return fallback, "workbook"
