"""Anomaly scores: isolation forest, kernel density, local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.operators.neighbors import matrix
from tablescope.operators.ordering import exact_quantiles, hash_order, number_rows
from tablescope.session import materialize

# Forest size, rows per tree, reason texts.
TREES = 100
ROWS_PER_TREE = 256
ABOVE, WITHIN = "score_above_threshold", "within_normal_range"

_FOURIER = 256
_EULER = 0.5772156649015329


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (id, feature, cut, left, right, length) of one random tree; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, x, 0)]
    used = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or len(splittable) == 0:
            nodes.append((node, -1, 0.0, 0, 0, depth + _path_length(len(rows))))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] <= cut
        if below.all() or not below.any():  # the cut fell on the border value
            cut = float(low[f])
            below = rows[:, f] <= cut
        nodes.append((node, f, cut, used, used + 1, 0.0))
        todo += [(used, rows[below], depth + 1), (used + 1, rows[~below], depth + 1)]
        used += 2
    return nodes


def isolation_scores(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: int = 42, trees: int = TREES) -> DataFrame:
    """``df`` plus ``_raw_score`` in (0, 1), higher is stranger.

    A pool of at most trees x 256 rows is drawn by key hash; each tree takes 256 of them
    (all, if there are fewer) by a hash of row and tree and is grown in its own task. Only the trees (a fixed number of nodes) reach every task
    that scores, and only the feature columns pass through Python.
    """
    spark = df.sparkSession
    n = df.count()
    size = min(ROWS_PER_TREE, n)
    wanted = min(n, trees * size)
    order = hash_order(key, seed)
    pool = df.select(order.alias("_h"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    share = 1.3 * wanted / max(1, n)
    if n > 10 * wanted:  # hashes are uniform: a prefix bound leaves a little more than needed
        pool = pool.filter(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") < F.lit(share * 2**32))
    pool = pool.orderBy("_h").limit(wanted)
    pool = materialize(pool)
    each = pool.select("_h", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_t"))
    place = F.row_number().over(W.partitionBy("_t").orderBy(F.xxhash64("_h", "_t"), "_h"))
    sampled = each.withColumn("_n", place).filter(F.col("_n") <= size).drop("_n").join(pool, "_h")
    width = len(cols)
    depth = max(1, math.ceil(math.log2(max(2, size))))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        t = int(frame["_t"].iloc[0])
        rng = np.random.default_rng([seed, t])
        frame = frame.sort_values("_h")
        x = frame[[f"x{i}" for i in range(width)]].to_numpy(dtype=float)
        out = pd.DataFrame(_grow(x, rng, depth), columns=["node", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", t)
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, length double"
    nodes = sampled.groupBy("_t").applyInPandas(grow, schema).toPandas()  # <= trees x 511 rows
    forest = []
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("node")
        forest.append(tuple(tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")))
    shared = spark.sparkContext.broadcast(forest)
    normal = _path_length(size) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            x = matrix(series)
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, left, right, length in shared.value:
                at = np.zeros(len(x), dtype=int)
                for _ in range(depth + 1):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go = np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at])
                    at = np.where(inner, go, at)
                total += length[at]
            yield pd.Series(np.power(2.0, -total / len(shared.value) / normal))

    return df.withColumn("_raw_score", score(*[F.col(f"`{c}`").cast("double") for c in cols]))


def kernel_scores(df: DataFrame, cols: Sequence[str], seed: int = 42, gamma: float | None = None) -> DataFrame:
    """``df`` plus ``_raw_score``: minus the mean Gaussian kernel to all rows.

    The kernel mean is taken in random Fourier features, so two passes over the rows
    replace all pairs. With nu near 1 a one-class SVM is this density estimate.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    if gamma is None:
        row = df.select(F.explode(F.array(*x)).alias("v")).agg(F.var_pop("v")).first()
        gamma = 1.0 / (len(cols) * row[0]) if row[0] else 1.0
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(len(cols), _FOURIER))
    b = rng.uniform(0.0, 2.0 * math.pi, size=_FOURIER)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(_FOURIER), 0
        for frame in batches:
            total += np.cos(frame.to_numpy(dtype=float) @ w + b).sum(axis=0)
            n += len(frame)
        yield pd.DataFrame({"i": np.arange(_FOURIER), "s": total, "n": n})

    parts = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)]).mapInPandas(sums, "i int, s double, n bigint")
    rows = parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()
    mean = np.array([r["m"] for r in rows]) * (2.0 / _FOURIER)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            at = matrix(series)
            yield pd.Series(-(np.cos(at @ w + b) @ mean))

    return df.withColumn("_raw_score", score(*x))


def flag_anomalies(df: DataFrame, score: str, contamination: float, shift: bool) -> DataFrame:
    """``_anomaly_score``, ``_is_anomaly``: the top ``contamination`` share by an exact quantile.

    ``shift`` moves the scores so that the cut is at 0.
    """
    cut = exact_quantiles(df, [score], [1.0 - contamination])[score][0]
    s = F.col(score)
    return df.withColumns({
        "_anomaly_score": s - F.lit(cut) if shift else s, "_is_anomaly": s > F.lit(cut)
    })


def anomaly_reason(flag: Column) -> Column:
    return F.when(flag, F.lit(ABOVE)).otherwise(F.lit(WITHIN))


def anomaly_rank(df: DataFrame, score: str, order_by: Sequence[str] = ("_row_id",), out: str = "_anomaly_rank") -> DataFrame:
    """1 for the highest score; ties in row order. Range-partitioned, no single-task sort."""
    return number_rows(df, [F.col(score).desc(), *[F.col(c).asc() for c in order_by]], out)
