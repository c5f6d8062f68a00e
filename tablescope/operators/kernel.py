"""Linear models on random cosine features that are never written: each pass over the rows makes them anew.

Rows are stored once as blocks of plain feature values. A pass computes the cosine features of a
block, loss and gradient, and returns one row per task; the driver holds the coefficients only.
Losses, regularisation, scaling, limits of steps and models are those of Spark ML's LinearSVC and
huber LinearRegression, which would keep a copy of the whole expanded table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import discard, materialize

# Rows whose features are in memory at once.
_ROWS = 2048
_MEMORY, _HISTORY = 10, 20


def blocks(rows: DataFrame) -> DataFrame:
    """(x, y, weight) as bytes of many rows each, from (features, y, weight); written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"x": [np.stack(b["x"].to_numpy()).tobytes()], "y": [b["y"].to_numpy().tobytes()], "weight": [b["weight"].to_numpy().tobytes()]})

    return materialize(rows.select(vector_to_array("features").alias("x"), "y", "weight").mapInPandas(run, "x binary, y binary, weight binary"))


def _summed(table: DataFrame, expand: Callable, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(features, y, weight)``, a vector per chunk of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x, y, w in zip(b["x"], b["y"], b["weight"]):
                y, w = np.frombuffer(y), np.frombuffer(w)
                x = np.frombuffer(x).reshape(len(y), -1)
                for at in range(0, len(y), _ROWS):
                    s = slice(at, at + _ROWS)
                    got = part(expand(x[s]), y[s], w[s])
                    total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    rows = table.mapInPandas(run, "total binary").collect()  # one row per task
    return np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """L-BFGS; steps are halved until they gain and doubled while the slope stays steep. Ends as Spark's optimizers do: no gain over the last values, or a flat gradient."""
    value, slope = f(x)
    first, past, pairs = value, [value], []
    for _ in range(steps):
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8):
            break
        way, kept = slope.copy(), []
        for s, g in reversed(pairs):
            a = (s @ way) / (s @ g)
            way -= a * g
            kept.append(a)
        if pairs:
            s, g = pairs[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(pairs, reversed(kept)):
            way += s * (a - (g @ way) / (s @ g))
        down = -(way @ slope)
        if down >= 0:
            way, down, pairs = slope.copy(), -(slope @ slope), []
        length, low, high, best = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(slope)), 0.0, np.inf, None
        for _ in range(20):
            at = f(x - length * way)
            if not (np.isfinite(at[0]) and at[0] <= value + 1e-4 * length * down):
                high = length
            else:
                best = length, at
                if -(way @ at[1]) >= 0.9 * down:
                    break
                low = length
            if best and high < np.inf:
                break
            length = 2.0 * length if high == np.inf else (low + high) / 2
        if best is None:
            break
        new, at = x - best[0] * way, best[1]
        s, g = new - x, at[1] - slope
        if s @ g > 1e-12 * np.sqrt((s @ s) * (g @ g)):
            pairs = [*pairs, (s, g)][-_MEMORY:]
        x, (value, slope) = new, at
        if abs(value - max(past)) <= tol * abs(first):
            break
        past = [*past, value][-_HISTORY:]
    return x


def fit(estimator: LinearSVC | LinearRegression, rows: DataFrame, kernel):
    """The Spark ML model ``estimator`` stands for, fitted to the cosine features of rows (features, y, weight)."""
    table = blocks(rows)
    expand, size = kernel.of, kernel.size
    facts = _summed(table, expand, lambda z, y, w: np.concatenate([[w.sum(), (w * w).sum(), w @ y, w @ (y * y)], w @ z, w @ (z * z)]))
    n, squares, mean = facts[0], facts[1], facts[4:4 + size] / facts[0]
    spread = np.sqrt(np.maximum(facts[4 + size:] - n * mean * mean, 0.0) / max(n - squares / n, 1e-300))
    # features are centred and scaled inside the solver, as Spark ML does
    inverse = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
    if isinstance(estimator, LinearSVC):
        penalty = estimator.getRegParam()

        def hinge(p: np.ndarray) -> tuple[float, np.ndarray]:
            coef = p[:-1] * inverse
            shift = p[-1] - mean @ coef

            def part(z, y, w):
                sign = 2.0 * y - 1.0
                short = 1.0 - sign * (z @ coef + shift)
                pull = np.where(short > 0, -sign * w, 0.0)
                return np.concatenate([[w @ np.maximum(short, 0.0), pull.sum()], pull @ z])

            got = _summed(table, expand, part) / n
            return got[0] + 0.5 * penalty * (p[:-1] @ p[:-1]), np.append((got[2:] - mean * got[1]) * inverse + penalty * p[:-1], got[1])

        found = minimize(hinge, np.zeros(size + 1), estimator.getMaxIter(), estimator.getTol())
        discard(table)
        return _model(rows, LinearSVCModel, found[:-1] * inverse, float(found[-1] - mean @ (found[:-1] * inverse)))
    epsilon = estimator.getEpsilon()

    def huber(p: np.ndarray) -> tuple[float, np.ndarray]:
        coef, scale = p[:-2] * inverse, float(p[-1])
        shift = p[-2] - mean @ coef
        if scale <= 0:
            return np.inf, p * 0.0

        def part(z, y, w):
            away = y - z @ coef - shift
            far = np.abs(away) > scale * epsilon
            loss = np.where(far, scale + 2.0 * epsilon * np.abs(away) - scale * epsilon ** 2, scale + away ** 2 / scale) / 2
            pull = -w * np.where(far, np.sign(away) * epsilon, away / scale)
            by_scale = np.where(far, 1.0 - epsilon ** 2, 1.0 - (away / scale) ** 2) / 2
            return np.concatenate([[w @ loss, w @ by_scale, pull.sum()], pull @ z])

        got = _summed(table, expand, part) / n
        return got[0], np.concatenate([(got[3:] - mean * got[2]) * inverse, [got[2], got[1]]])

    centre = facts[2] / n
    start = np.concatenate([np.zeros(size), [centre, np.sqrt(max(facts[3] / n - centre ** 2, 1e-12))]])
    found = minimize(huber, start, estimator.getMaxIter(), estimator.getTol())
    discard(table)
    return _model(rows, LinearRegressionModel, found[:-2] * inverse, float(found[-2] - mean @ (found[:-2] * inverse)), float(found[-1]))


def _model(rows: DataFrame, kind: type, coef: np.ndarray, *rest: float):
    spark = rows.sparkSession
    package = "classification" if kind is LinearSVCModel else "regression"
    made = getattr(getattr(spark._jvm.org.apache.spark.ml, package), kind.__name__)(f"{kind.__name__}_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(coef)), *rest)
    return kind(made)


def margins(kernel, model: LinearSVCModel | LinearRegressionModel, x: Column) -> Column:
    """What a linear model says about the cosine features of an array of plain ones."""
    coef, shift = model.coefficients.toArray(), model.intercept

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            m = np.stack(b.to_numpy()) if len(b) else np.zeros((0, kernel.width))
            yield pd.Series(np.concatenate([np.zeros(0), *[kernel.of(m[at:at + _ROWS]) @ coef + shift for at in range(0, len(m), _ROWS)]]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(x)
