"""Registered queries: operators applied to the test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from tablescope.catalog import (
        explore, features, formulas, geometry, lineage, models, profiles, recommendations, rows, splits,
    )

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (profiles, rows, formulas, features, splits, recommendations, lineage, geometry, models, explore):
        out.update(module.QUERIES)
    return out
