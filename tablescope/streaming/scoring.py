"""Batch prediction applied to an unbounded input: scoring keeps no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablescope.operators.models import FittedModel, predict


def score_stream(model: FittedModel, rows: DataFrame) -> DataFrame:
    if not rows.isStreaming:
        raise ValueError("score_stream needs a streaming DataFrame; use predict for tables")
    return predict(model, rows)


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score what is there and stop; a restart continues after the last finished batch."""
    return scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
