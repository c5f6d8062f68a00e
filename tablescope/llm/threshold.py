"""Exact top k by inner product: threshold algorithm over sorted lists, one list a dimension."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.columns import arrow_rows
from tablescope.llm.vectors import Best, batch_rows, integer_vectors, matrix, query_parts
from tablescope.session import materialize

#: Components of the rows whose lists are sorted together.
_CHUNK = 1 << 20
#: Rows scored between two looks at the bounds.
_STEP = 512
#: Queries scored together.
_ASK = 1024
_FLOAT_EXACT = 1 << 53


def _product(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer ``a @ b.T``; sums below 2**53 are exact in float64, larger ones use integers."""
    if bound < _FLOAT_EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def scan_lists(ask: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Offer ``rows`` to ``best`` for every query, list by list from both ends; rows scored, over all queries.

    Each dimension is a list of the rows in order of its values. All lists are read in step from
    the high and from the low end (a negative weight wants low values), and a row is scored where
    it first comes up. After depth t an unread row has, in each dimension, a value between the two
    at depth t, so its score is at most the weights times the better of these: the threshold. A
    query goes on while its k-th score does not beat the threshold (an equal score may still have
    a smaller id). Queries share the reading; a row one query would not have met yet is only
    scored sooner.
    """
    n, dim = rows.shape
    if not n:
        return 0
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, 0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], 0)
    depth = np.minimum(place, n - 1 - place).min(axis=1) if dim else np.zeros(n, dtype=np.int64)
    reading = np.argsort(depth, kind="stable")
    up, down = np.maximum(ask, 0).astype(np.float64), np.minimum(ask, 0).astype(np.float64)
    exact = float(np.abs(ask).sum(axis=1).max(initial=0)) * float(np.abs(rows).max(initial=0)) < _FLOAT_EXACT

    scored = 0
    for first in range(0, len(ask), _ASK):
        live = np.arange(first, min(len(ask), first + _ASK))
        for start in range(0, n, _STEP):
            t = depth[reading[start]]
            limit = up[live] @ lists[n - 1 - t] + down[live] @ lists[t]
            live = live[best.worst[live] <= (limit if exact else limit + np.abs(limit) * 1e-9 + 1)]
            if not live.size:
                break
            near = np.sort(reading[start:start + _STEP])  # rows ascend by id
            scores = _product(ask[live], rows[near], best.bound)
            scores[names[live, None] == ids[near]] = best.none
            best.add(live, scores, ids[near])
            scored += scores.size
    return scored


def top_k(df: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best other rows of each query row, over all rows: query_id, rank (from 1), vec_id, score.

    A score is the integer inner product of ``floor(scale * x)`` components; ties go to the smaller
    id; where fewer rows exist, all are given. What takes part, and what repeated ids mean, is told
    by ``integer_vectors``. An empty table, or one without queries, gives no rows. Extra columns of
    ``df`` are not read. Lists are sorted for chunks of rows; a task carries the k-th score from
    chunk to chunk, so later chunks stop sooner, or are not read at all. Queries come in parts of
    bounded size; a task returns k rows for each.
    """
    vectors = integer_vectors(df, id, vector, queries, scale=scale)
    spark, dim, bound = df.sparkSession, vectors.dim, vectors.bound
    chunk = max(256, _CHUNK // max(1, dim))
    out = []
    for _, part in query_parts(vectors):
        shipped = spark.sparkContext.broadcast((part["id"].to_numpy(), matrix(part["q"].combine_chunks(), dim)))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, ask = shipped.value
            best = Best(len(names), k, bound)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def scan() -> None:
                ids, rows = (np.concatenate(x) for x in zip(*held))
                by_id = np.argsort(ids)
                scan_lists(ask, names, rows[by_id], ids[by_id], best)
                held.clear()

            for batch in batches:
                held.append((batch["id"].to_numpy(), matrix(batch["q"], dim)))
                if sum(len(x) for x, _ in held) >= chunk:
                    scan()
            if held:
                scan()
            at, found, score = best.found()
            for s in range(0, len(at), 10_000):
                cut = slice(s, s + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[at[cut]]), pa.array(found[cut]), pa.array(score[cut])], names=["query_id", "vec_id", "score"])

        with arrow_rows(spark, batch_rows(dim)):
            out.append(materialize(vectors.rows.select("id", "q").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")))
        shipped.unpersist()
    if not out:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
