"""Hard negatives by exact integer scores from a residue-number-system matrix product."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.columns import arrow_rows
from tablescope.llm.vectors import Best, Vectors, batch_rows, integer_vectors, matrix, query_parts
from tablescope.session import materialize

#: Whole numbers up to here, and their sums in between, are exact in float32 with a bit to spare.
_EXACT = 1 << 23
#: Rows and columns of a tile of scores.
_TILE = 1024


class Residues:
    """Primes whose product exceeds twice ``bound``, for vectors of ``dim`` components.

    The primes are as large as exact float32 sums over all components allow, so few are
    needed; very long vectors are multiplied in stretches of ``stretch`` components.
    """

    def __init__(self, dim: int, bound: int):
        half = min(1023, max(63, math.isqrt(_EXACT // max(1, dim))))
        self.stretch = _EXACT // (half * half)
        self.primes: list[int] = []
        p = 2 * half + 1
        while math.prod(self.primes) <= 2 * bound + 1:
            while any(p % d == 0 for d in range(3, math.isqrt(p) + 1, 2)):
                p -= 2
            self.primes.append(p)
            p -= 2

    def split(self, whole: np.ndarray) -> list[np.ndarray]:
        """Component matrices: centred remainders by each prime, in float32."""
        out = []
        for p in self.primes:
            r = np.mod(whole, p)
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    @staticmethod
    def _centre(x: np.ndarray, p: int) -> np.ndarray:
        """Remainder in -p/2 .. p/2; the second round mends quotients rounded to the wrong side."""
        for _ in range(2):
            x = x - np.float32(p) * np.rint(x * np.float32(1 / p))
        return x

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact int64 ``a @ b.T`` from component products, by mixed-radix Chinese remaindering."""
        total = np.zeros((a[0].shape[0], b[0].shape[0]), dtype=np.int64)
        digits: list[np.ndarray] = []
        weight = 1
        for n, p in enumerate(self.primes):
            rest = np.zeros(total.shape, dtype=np.float32)
            for start in range(0, a[n].shape[1], self.stretch):
                cut = slice(start, start + self.stretch)
                rest = self._centre(rest + self._centre(a[n][:, cut] @ b[n][:, cut].T, p), p)
            for q, digit in zip(self.primes, digits):
                inverse = pow(q, -1, p)
                rest = self._centre((rest - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
            digits.append(rest)
            # weights may pass 64 bits; the sum wraps back since every score is within them
            total += rest.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
            weight *= p
        return total


Mask = Callable[[int, slice, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _scan(vectors: Vectors, asked: dict[str, np.ndarray], searches: int, k: int, allowed: Mask) -> DataFrame:
    """(at, search, id, score): per task the ``k`` best rows for ``searches`` searches of each asking row.

    ``allowed(search, asking rows, scores, ids, labels)`` marks the scores that count. Every task
    holds one part of the asking rows and streams its candidates; scores exist only as tiles.
    """
    spark = vectors.rows.sparkSession
    system = Residues(vectors.dim, vectors.bound)
    dim, bound = vectors.dim, vectors.bound
    shipped = spark.sparkContext.broadcast(asked["q"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = system.split(shipped.value)
        n = len(shipped.value)
        best = [Best(n, k, bound) for _ in range(searches)]
        for batch in batches:
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            order = np.argsort(ids)
            ids, labels, rows = ids[order], labels[order], matrix(batch["q"], dim)[order]
            for left in range(0, len(ids), _TILE):
                near = slice(left, left + _TILE)
                parts = system.split(rows[near])
                for top in range(0, n, _TILE):
                    own = slice(top, min(n, top + _TILE))
                    scores = system.product([a[own] for a in ask], parts)
                    for search in range(searches):
                        ok = allowed(search, own, scores, ids[near], labels[near])
                        best[search].add(np.arange(own.start, own.stop), np.where(ok, scores, -bound - 1), ids[near])
        for search in range(searches):
            at, found, score = best[search].found()
            for s in range(0, len(at), 10_000):
                cut = slice(s, s + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[cut], pa.int64()), pa.array(np.full(len(at[cut]), search), pa.int64()), pa.array(found[cut]), pa.array(score[cut])],
                    names=["at", "search", "id", "score"])

    with arrow_rows(spark, batch_rows(dim)):
        out = materialize(vectors.rows.select("id", "label", "q").mapInArrow(tiles, "at bigint, search bigint, id bigint, score bigint"))
    shipped.unpersist()
    return out


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(
    df: DataFrame, anchors: Column, label: Column, id: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of ``floor(scale * x)`` components. An anchor's positives
    are its ``positives`` best other rows of the same label; a negative has another label and a
    score between ``low`` and ``high`` percent of the positive's, both included. Best scores come
    first, ties by smaller id. What takes part, and what repeated ids mean, is told by
    ``integer_vectors``. An empty table, or one without anchors, gives no rows. Extra columns of
    ``df`` are not read. Work: anchors times rows, twice; nothing but the best rows of each task
    leaves it.
    """
    vectors = integer_vectors(df, id, vector, anchors, label, scale)
    out = []
    for _, part in query_parts(vectors):
        names, labels = part["id"].to_numpy(), part["label"].to_numpy()
        asked = {"q": matrix(part["q"].combine_chunks(), vectors.dim)}

        def same(search, own, scores, ids, classes, names=names, labels=labels):
            return (labels[own, None] == classes) & (names[own, None] != ids)

        mine = _first(_scan(vectors, asked, 1, positives, same), ["at"], positives)
        # at most `positives` rows for each asking row of this part
        chosen = mine.select("at", "rank", "id", "score").toArrow()
        at, rank = chosen["at"].to_numpy(), chosen["rank"].to_numpy() - 1
        positive = np.zeros((len(names), positives), dtype=np.int64)
        score = np.zeros_like(positive)
        from_, to = np.ones_like(positive), np.zeros_like(positive)  # an empty window where there is no positive
        positive[at, rank], score[at, rank] = chosen["id"].to_numpy(), chosen["score"].to_numpy()
        from_[at, rank], to[at, rank] = -(-low * score[at, rank] // 100), high * score[at, rank] // 100

        def window(search, own, scores, ids, classes, labels=labels, from_=from_, to=to):
            return (labels[own, None] != classes) & (scores >= from_[own, search, None]) & (scores <= to[own, search, None])

        found = _first(_scan(vectors, asked, positives, negatives, window), ["at", "search"], negatives)
        out.append(found.join(_pairs(df, names, positive, score, at, rank), ["at", "search"]))
    if not out:
        return df.sparkSession.createDataFrame([], _COLUMNS)
    return reduce(DataFrame.unionByName, out).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


_COLUMNS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _pairs(df: DataFrame, names: np.ndarray, positive: np.ndarray, score: np.ndarray, at: np.ndarray, rank: np.ndarray) -> DataFrame:
    """The anchors and positives of one part as a table, stored so that plans do not carry it."""
    table = pa.table({"at": at.astype(np.int64), "search": rank.astype(np.int64), "anchor_id": names[at],
                      "positive_id": positive[at, rank], "positive_score": score[at, rank]})
    return materialize(df.sparkSession.createDataFrame(table))
