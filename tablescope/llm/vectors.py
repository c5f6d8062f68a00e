"""Integer vectors, bounded query blocks and exact top rows for the searches of this package."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize, small

#: Squared lengths from here on could not be scored and compared in 64 bits.
LARGEST = 1 << 55
#: Bytes of query components that tasks hold at once.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class Vectors:
    """Stored rows (id, label, ask, q), their number, longest vector and a bound of any |score|."""

    rows: DataFrame
    count: int
    dim: int
    bound: int


def integer_vectors(df: DataFrame, id: str, vector: str, ask: Column, label: Column | None = None, scale: int = 256) -> Vectors:
    """Rows of ``df`` with ``floor(scale * x)`` for each component, written once.

    Rows with a null id, a null vector, a null or non-finite component, or (where ``label``
    is given) a null label take no part. An id stands for one row: of several rows the one
    with the smallest label, then the smallest vector, counts. Shorter vectors count as
    filled up with zeros. Squared lengths of ``LARGEST`` or more raise ValueError.
    """
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(
        F.col(f"`{id}`").cast("bigint").alias("id"), (F.lit(0) if label is None else label).cast("bigint").alias("label"),
        F.coalesce(ask, F.lit(False)).alias("ask"),
        F.when(finite, F.transform(x, lambda v: F.floor(v.cast("double") * scale))).alias("q"),
    ).dropna()
    rows = materialize(rows)
    again = rows.groupBy("id").count().filter("count > 1").select("id")
    if not again.isEmpty():
        again = small(materialize(again))
        one = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "q", "ask")).alias("r"))
        rows = materialize(rows.join(again, "id", "left_anti").unionByName(one.select("id", "r.label", "r.ask", "r.q")))
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, dim, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).first()
    if longest is not None and longest >= LARGEST:
        raise ValueError(f"squared length {longest:.3g} of a vector leaves no room for 64-bit scores")
    return Vectors(rows, n, dim or 0, math.ceil((longest or 0.0) * (1 + 1e-9)) + 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List array as an int64 matrix of ``dim`` columns, short rows filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def part_of(id: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(parts))


def query_parts(vectors: Vectors, part_bytes: int = PART_BYTES) -> Iterator[tuple[Column, pa.Table]]:
    """The asking rows in parts of about ``part_bytes``: (condition on ``id``, rows by id).

    Each part goes through the driver to the tasks by itself, so the memory it takes does
    not grow with the table; ids are distinct, so hashing deals them evenly.
    """
    asking = vectors.rows.filter("ask").select("id", "label", "q")
    parts = max(1, math.ceil(asking.count() * max(1, vectors.dim) * 8 / part_bytes))
    for part in range(parts):
        mine = part_of("id", parts) == part
        table = asking.filter(mine).toArrow().sort_by("id").combine_chunks()
        if table.num_rows:
            yield mine, table


def batch_rows(dim: int) -> int:
    """Rows in an Arrow batch: about 4 MB of components."""
    return max(64, min(8192, (4 << 20) // (8 * max(1, dim))))


def top(scores: np.ndarray, k: int, bound: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of each row, best first; ties go to the left."""
    width = scores.shape[1]
    if (bound + 2) * width >= 1 << 62:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    key = scores * width + np.arange(width - 1, -1, -1)
    if k < width:
        part = np.argpartition(key, width - k, axis=1)[:, width - k:]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(key, part, 1), axis=1), 1)
    return np.argsort(-key, axis=1)


class Best:
    """The ``k`` best (score, id) of each of ``n`` searches; ties go to the smaller id."""

    def __init__(self, n: int, k: int, bound: int):
        self.k, self.bound, self.none = k, bound, -bound - 1
        self.scores = np.full((n, k), self.none, dtype=np.int64)
        self.ids = np.zeros((n, k), dtype=np.int64)

    @property
    def worst(self) -> np.ndarray:
        """Score of the k-th, or ``none`` where there are fewer."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer scored columns to the searches ``at``; ``ids`` ascend, ``none`` marks columns left out."""
        hit = (scores.max(axis=1) >= self.scores[at, -1]) & (scores.max(axis=1) > self.none)
        at, scores = at[hit], scores[hit]
        if not at.size:
            return
        pick = top(scores, self.k, self.bound)
        s = np.concatenate([self.scores[at], np.take_along_axis(scores, pick, 1)], axis=1)
        i = np.concatenate([self.ids[at], ids[pick]], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, id, score) of everything found."""
        row, col = np.nonzero(self.scores > self.none)
        return row, self.ids[row, col], self.scores[row, col]
