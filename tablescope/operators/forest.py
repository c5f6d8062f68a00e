"""Forests and boosted trees fitted on counts of binned rows, whatever the number of rows.

A tree compares a feature only with the candidates between its bins, so rows whose features fall
into the same bins (a cell) are one to it. One pass counts the rows of each cell: by class, or with
sum and squares of the target. Trees then grow on cells, of which there are at most as many as
combinations of bins. Gains, predictions and importances are those of the single rows. A bootstrap
counts each row Poisson(1) times: for the rows of a cell and class that is Poisson(n), for a
numeric target the draws are made row by row and summed up per cell. The results are Spark ML
models.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize, shared_folder, small

#: Cells up to which trees grow on them; beyond that Spark ML works on the rows.
MAX_CELLS = 1 << 20
#: Widest vector and most classes for which cells are tried.
MAX_WIDTH, MAX_CLASSES = 64, 64
# Rows of a task that draws the bootstraps of a numeric target.
_DRAW_ROWS = 250_000
_ACCURACY = 10_000

NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
)


@dataclass
class Bins:
    """Ascending cuts per feature: bin i holds cuts[i - 1] < x <= cuts[i]."""

    cuts: list[np.ndarray]

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Number of the cell of each row of a matrix."""
        out = np.zeros(len(x), dtype=np.int64)
        for i, cuts in enumerate(self.cuts):
            out = out * (len(cuts) + 1) + np.searchsorted(cuts, x[:, i], side="left")
        return out

    def bins(self, cell: np.ndarray) -> np.ndarray:
        """Bins by feature (features x cells) of cell numbers."""
        out, rest = [], cell.copy()
        for size in reversed(self.sizes):
            out.append(rest % size)
            rest //= size
        return np.array(out[::-1])


def fit_bins(vectors: DataFrame, width: int, most: int) -> Bins:
    """Cuts between all values of a feature that has at most ``most``, else at its quantiles.

    Two passes over all rows; quantiles are those of a sketch with a bounded rank error.
    """
    x = vector_to_array("features")
    wide = vectors.select(*[x[i].alias(f"x{i}") for i in range(width)])
    probs = [j / most for j in range(1, most)]
    found = wide.agg(
        *[F.approx_count_distinct(f"x{i}").alias(f"k{i}") for i in range(width)],
        *[F.percentile_approx(f"x{i}", probs, _ACCURACY).alias(f"q{i}") for i in range(width)], *[F.max(f"x{i}").alias(f"m{i}") for i in range(width)]).first()
    few = [i for i in range(width) if found[f"k{i}"] <= 2 * most]
    values = wide.agg(*[F.collect_set(f"x{i}").alias(f"v{i}") for i in few]).first() if few else {}
    cuts = []
    for i in range(width):
        listed = np.unique(values[f"v{i}"]) if i in few else np.zeros(0)
        if i in few and len(listed) <= most:
            cuts.append((listed[1:] + listed[:-1]) / 2)
        else:
            at = np.unique(found[f"q{i}"])
            cuts.append(at[at < found[f"m{i}"]])
    return Bins(cuts)


def celled(vectors: DataFrame, bins: Bins) -> DataFrame:
    """(cell, y, weight) of rows with a vector ``features``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": bins.cell(np.stack(b["x"].to_numpy())), "y": b["y"], "weight": b["weight"]})

    return vectors.select(vector_to_array("features").alias("x"), "y", "weight").mapInPandas(run, "cell bigint, y double, weight double")


def bins_for(vectors: DataFrame, width: int, most: int) -> Bins | None:
    """Bins whose cells are few enough, or nothing."""
    if width > MAX_WIDTH:
        return None
    bins = fit_bins(vectors, width, most)
    if math.prod(bins.sizes) <= MAX_CELLS:
        return bins
    if math.prod(bins.sizes) >= 1 << 62:
        return None
    rows = celled(vectors.select("features", F.lit(0.0).alias("y"), F.lit(1.0).alias("weight")), bins)
    return bins if rows.agg(F.approx_count_distinct("cell")).first()[0] <= MAX_CELLS else None


class _Variance:
    """Weight, sum and squares of a target."""

    width = 3

    @staticmethod
    def weight(s: np.ndarray) -> np.ndarray:
        return s[..., 0]

    @staticmethod
    def impurity(s: np.ndarray) -> np.ndarray:
        w = np.maximum(s[..., 0], 1e-300)
        return np.maximum(s[..., 2] / w - (s[..., 1] / w) ** 2, 0.0)

    @staticmethod
    def prediction(s: np.ndarray) -> np.ndarray:
        return s[..., 1] / np.maximum(s[..., 0], 1e-300)

    @staticmethod
    def score(s: np.ndarray) -> np.ndarray:
        """What a split adds up over its two sides: highest where their weighted impurity is lowest."""
        return s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)


class _Gini:
    """Weight per class."""

    def __init__(self, classes: int):
        self.width = classes

    @staticmethod
    def weight(s: np.ndarray) -> np.ndarray:
        return s.sum(-1)

    @staticmethod
    def impurity(s: np.ndarray) -> np.ndarray:
        w = np.maximum(s.sum(-1), 1e-300)
        return 1.0 - ((s / w[..., None]) ** 2).sum(-1)

    @staticmethod
    def prediction(s: np.ndarray) -> np.ndarray:
        return s.argmax(-1).astype(float)

    @staticmethod
    def score(s: np.ndarray) -> np.ndarray:
        return (s ** 2).sum(-1) / np.maximum(s.sum(-1), 1e-300)


def grow(bins: np.ndarray, sizes: list[int], stats: np.ndarray, kind: _Variance | _Gini, depth: int, subset: int, rng: np.random.Generator) -> tuple[list[dict], np.ndarray]:
    """(nodes, leaf of each cell): one tree over cells, level by level.

    ``bins``: features x cells; ``stats``: cells x ``kind.width``. Each node looks at ``subset``
    features drawn anew. A split needs rows on both sides and a gain.
    """
    d = len(sizes)
    total = stats.sum(0)
    nodes = [{"stats": total, "gain": -1.0}]
    at = np.zeros(bins.shape[1], dtype=np.int64)
    level = np.array([0])
    for _ in range(depth):
        place = np.full(len(nodes), -1)
        place[level] = np.arange(len(level))
        mine = np.nonzero(place[at] >= 0)[0]
        local, m = place[at[mine]], len(level)
        own = np.array([nodes[i]["stats"] for i in level])
        allowed = np.argsort(rng.random((m, d)), axis=1).argsort(axis=1) < subset
        best = np.zeros(m)
        choice = np.full((m, 2), -1)
        weight, base = kind.weight(own), kind.score(own)
        least = 1e-12 * np.maximum(kind.impurity(own), 1e-300)
        for f in range(d):
            if sizes[f] < 2 or not allowed[:, f].any():
                continue
            slot = local * sizes[f] + bins[f, mine]
            hist = np.stack([np.bincount(slot, stats[mine, j], m * sizes[f]) for j in range(kind.width)], -1).reshape(m, sizes[f], kind.width)
            left = hist.cumsum(1)[:, :-1]
            right = own[:, None] - left
            valid = (kind.weight(left) > 1e-9) & (kind.weight(right) > 1e-9) & allowed[:, f, None]
            gain = np.where(valid, (kind.score(left) + kind.score(right) - base[:, None]) / np.maximum(weight, 1e-300)[:, None], -1.0)
            cut = gain.argmax(1)
            top = gain[np.arange(m), cut]
            better = (top > best) & (top > least)
            best[better] = top[better]
            choice[better] = np.stack([np.full(m, f), cut], 1)[better]
        split = np.nonzero(choice[:, 0] >= 0)[0]
        if not len(split):
            break
        first = np.full(m, -1)
        first[split] = len(nodes) + 2 * np.arange(len(split))
        moving = first[local] >= 0
        rows, local = mine[moving], local[moving]
        goes = bins[choice[local, 0], rows] > choice[local, 1]
        at[rows] = first[local] + goes
        count = 2 * len(split)
        child = at[rows] - len(nodes)
        below = np.stack([np.bincount(child, stats[rows, j], count) for j in range(kind.width)], -1)
        for j, s in enumerate(split):
            nodes[level[s]].update(gain=float(best[s]), feature=int(choice[s, 0]), cut=int(choice[s, 1]), left=len(nodes) + 2 * j, right=len(nodes) + 2 * j + 1)
        level = len(nodes) + np.arange(count)
        nodes += [{"stats": s, "gain": -1.0} for s in below]
    return nodes, at


def _rows(nodes: list[dict], bins: Bins, kind: _Variance | _Gini, prune: bool) -> list[tuple]:
    """Rows of ``NODE``, numbered from the root in preorder. Leaves that say the same are one, as in Spark ML's forests."""
    s = np.array([n["stats"] for n in nodes])
    said, impure, weight = kind.prediction(s), kind.impurity(s), kind.weight(s)
    leaf = ["left" not in n for n in nodes]
    if prune:
        for i in range(len(nodes) - 1, -1, -1):
            n = nodes[i]
            if not leaf[i] and leaf[n["left"]] and leaf[n["right"]] and said[n["left"]] == said[n["right"]]:
                leaf[i] = True
    out: list[list] = []
    stack = [(0, -1, 0)]
    while stack:
        i, parent, side = stack.pop()
        n, at = nodes[i], len(out)
        if parent >= 0:
            out[parent][side] = at
        split = (-1, [], -1) if leaf[i] else (n["feature"], [float(bins.cuts[n["feature"]][n["cut"]])], -1)
        out.append([at, float(said[i]), float(impure[i]), [float(v) for v in s[i]], int(round(weight[i])), -1.0 if leaf[i] else n["gain"], -1, -1, split])
        if not leaf[i]:
            stack += [(n["right"], at, 7), (n["left"], at, 6)]
    return [tuple(r) for r in out]


def _subset(width: int, classification: bool) -> int:
    """Features a node of a forest looks at: Spark ML's choice."""
    return math.ceil(math.sqrt(width)) if classification else math.ceil(width / 3.0)


def _counts(vectors: DataFrame, bins: Bins) -> pd.DataFrame:
    """(cell, y, n, weight) on the driver: rows and weight by cell and class, at most ``MAX_CELLS`` cells."""
    return celled(vectors, bins).groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).orderBy("cell", "y").toPandas()


def _forest_by_class(vectors: DataFrame, bins: Bins, classes: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(treeID, nodeData): each tree draws how often the rows of a cell and class count."""
    spark = vectors.sparkSession
    table = _counts(vectors, bins)
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("cell", "y", "n", "weight")))
    subset = _subset(len(bins.cuts), True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, y, n, weight = shared.value
            for tree in b["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                drawn = rng.poisson(n) * weight
                cells, place = np.unique(cell, return_inverse=True)
                stats = np.bincount(place * classes + y.astype(np.int64), drawn, len(cells) * classes).reshape(-1, classes)
                yield _grown(int(tree), cells, stats, bins, _Gini(classes), depth, subset, rng)

    return spark.range(0, trees, 1, trees).mapInPandas(run, f"treeID int, nodeData struct<{_struct()}>")


def _grown(tree: int, cells: np.ndarray, stats: np.ndarray, bins: Bins, kind, depth: int, subset: int, rng) -> pd.DataFrame:
    kept = kind.weight(stats) > 0
    if kept.any():
        cells, stats = cells[kept], stats[kept]
    nodes, _ = grow(bins.bins(cells), bins.sizes, stats, kind, depth, subset, rng)
    return _table(tree, _rows(nodes, bins, kind, True))


def _table(tree: int, rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in NODE.split(", ")]
    inner = ("featureIndex", "leftCategoriesOrThreshold", "numCategories")
    return pd.DataFrame({"treeID": [tree] * len(rows), "nodeData": [{**dict(zip(names, r)), "split": dict(zip(inner, r[-1]))} for r in rows]})


def _struct() -> str:
    return ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in NODE.split(", "))


def _forest_by_sum(vectors: DataFrame, bins: Bins, trees: int, depth: int, seed: int) -> DataFrame:
    """(treeID, nodeData) for a numeric target: draws are made for each row and summed up by cell and tree.

    Rows that agree in cell and target are drawn together, which is the same; those of a cell meet in
    one task, unless it has most of the rows: then it is several, whose sums are added up.
    """
    rows = materialize(celled(vectors, bins).groupBy("cell", "y", "weight").agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, math.ceil(rows.count() / _DRAW_ROWS))
    crowded = small(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _DRAW_ROWS).cast("int").alias("salts")).filter("salts > 1"))
    salt = F.pmod(F.xxhash64("y", "weight"), F.coalesce("salts", F.lit(1)))
    dealt = rows.join(crowded, "cell", "left").withColumn("salt", salt.cast("int")).select("cell", "salt", "y", "weight", "n").repartition(parts, "cell", "salt")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [b for b in batches if len(b)]
        if not all_:
            return
        t = pd.concat(all_).sort_values(["cell", "salt", "y", "weight"], kind="stable")
        cells, place = np.unique(t["cell"].to_numpy(), return_inverse=True)
        y, n, weight = t["y"].to_numpy(), t["n"].to_numpy(), t["weight"].to_numpy()
        first = int(t["cell"].iloc[0]), int(t["salt"].iloc[0])
        for tree in range(trees):
            k = np.random.default_rng([seed, tree, *first]).poisson(n) * weight
            sums = [np.bincount(place, k * f, len(cells)) for f in (np.ones_like(y), y, y * y)]
            yield pd.DataFrame({"tree": [tree], "cells": [cells.tobytes()], "sums": [np.stack(sums, -1).tobytes()]})

    drawn = dealt.mapInPandas(draw, "tree int, cells binary, sums binary")
    subset = _subset(len(bins.cuts), False)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        tree = int(t["tree"].iloc[0])
        cell = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in t["cells"]])
        sums = np.concatenate([np.frombuffer(b, dtype=np.float64).reshape(-1, 3) for b in t["sums"]])
        cells, place = np.unique(cell, return_inverse=True)
        stats = np.stack([np.bincount(place, sums[:, j], len(cells)) for j in range(3)], -1)
        return _grown(tree, cells, stats, bins, _Variance(), depth, subset, np.random.default_rng([seed, tree, 1]))

    return drawn.repartition(trees, "tree").groupBy("tree").applyInPandas(run, f"treeID int, nodeData struct<{_struct()}>")


def forest(vectors: DataFrame, bins: Bins, classes: int, trees: int, depth: int, seed: int, params: dict) -> tuple[Model, Scorer]:
    """Random forest over rows (features, y, weight); ``classes`` is 0 for a numeric target."""
    data = _forest_by_class(vectors, bins, classes, trees, depth, seed) if classes else _forest_by_sum(vectors, bins, trees, depth, seed)
    kind = RandomForestClassificationModel if classes else RandomForestRegressionModel
    return _model(kind, data, bins, [1.0] * trees, classes, {**params, "numTrees": trees, "maxDepth": depth, "seed": seed})


def boosted(vectors: DataFrame, bins: Bins, classification: bool, rounds: int, depth: int, step: float, params: dict) -> tuple[Model, Scorer]:
    """Gradient boosting over rows (features, y, weight): squared error, or logistic loss of classes 0 and 1.

    The squared error of a cell's rows splits into that of their mean and a part no tree changes, so
    a cell is one weighted row with the mean target; of two classes it has two rows.
    """
    spark = vectors.sparkSession
    if classification:
        table = _counts(vectors, bins)
        cell, weight = table["cell"].to_numpy(), (table["n"] * table["weight"]).to_numpy(dtype=float)
        y = 2.0 * table["y"].to_numpy() - 1.0
    else:
        found = celled(vectors, bins).groupBy("cell").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("s")).orderBy("cell").toPandas()
        cell, weight = found["cell"].to_numpy(), found["w"].to_numpy(dtype=float)
        y = found["s"].to_numpy() / weight
    cells, place = np.unique(cell, return_inverse=True)
    by_feature, kind, rng = bins.bins(cells), _Variance(), np.random.default_rng(0)
    total, made = np.zeros(len(cells)), []
    for turn in range(max(1, rounds)):
        scale = 1.0 if turn == 0 else step
        f = total[place]
        aim = y if turn == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * f, 700.0))) if classification else 2.0 * (y - f)
        stats = np.stack([np.bincount(place, weight * v, len(cells)) for v in (np.ones_like(aim), aim, aim * aim)], -1)
        nodes, leaf = grow(by_feature, bins.sizes, stats, kind, depth, len(bins.cuts), rng)
        total += scale * kind.prediction(np.array([n["stats"] for n in nodes]))[leaf]
        made += [(turn, r) for r in _rows(nodes, bins, kind, True)]
    data = spark.createDataFrame(made, f"treeID int, nodeData struct<{_struct()}>")
    weights = [1.0] + [step] * (max(1, rounds) - 1)
    return _model(GBTClassificationModel if classification else GBTRegressionModel, data, bins, weights, 0, {**params, "maxIter": rounds, "maxDepth": depth, "stepSize": step})


def _model(kind: type, data: DataFrame, bins: Bins, weights: list[float], classes: int, params: dict) -> tuple[Model, Scorer]:
    """Spark ML model of the trees in ``data``, stored in Spark's own form and loaded, and its scorer."""
    spark = data.sparkSession
    path = os.path.join(shared_folder(spark), f"step-{uuid.uuid4().hex}")
    task = "Classification" if "Classification" in kind.__name__ else "Regression"
    package = f"org.apache.spark.ml.{task.lower()}"
    forests = kind in (RandomForestClassificationModel, RandomForestRegressionModel)
    impurity = "gini" if kind is RandomForestClassificationModel else "variance"
    # the trees of boosted classes are regressors
    tree = f"org.apache.spark.ml.{task.lower()}.DecisionTree{task}Model" if forests else "org.apache.spark.ml.regression.DecisionTreeRegressionModel"

    def described(name: str, uid: str, more: dict) -> str:
        return json.dumps({
            "class": name, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            "paramMap": {"impurity": impurity, **(params if more else {})}, "defaultParamMap": {}, **more})

    more = {"numFeatures": len(bins.cuts), "numTrees": len(weights)}
    if task == "Classification" and forests:
        more["numClasses"] = classes
    uid = f"{kind.__name__}_{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(described(f"{package}.{kind.__name__}", uid, more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, described(tree, f"tree_{uuid.uuid4().hex[:12]}", {}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    data.write.parquet(f"{path}/data")
    n = F.col("nodeData")
    flat = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("said"), n["impurityStats"].alias("stats"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("cut")).toPandas()
    trees = [g.sort_values("id") for _, g in flat.groupby("treeID")]
    named = [{c: g[c].to_numpy() for c in ("feature", "cut", "left", "right", "said")} for g in trees]
    if classes:
        for tree, g in zip(named, trees):
            stats = np.stack(g["stats"].to_numpy())
            tree["said"] = stats / np.maximum(stats.sum(1), 1e-300)[:, None]
    way = "vote" if classes else "mean" if forests else "logistic" if task == "Classification" else "sum"
    return kind.load(path), Scorer(bins, named, weights, way)


class Scorer:
    """What the model says about a row, worked out once per task for each cell of rows."""

    def __init__(self, bins: Bins, trees: list[dict[str, np.ndarray]], weights: list[float], way: str):
        self.bins, self.trees, self.weights, self.way = bins, trees, weights, way

    def of(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities (rows x classes) or value (rows x 1) of the rows of a matrix."""
        total, rows = 0.0, np.arange(len(x))
        for tree, weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = tree["left"][at] >= 0
                if not inner.any():
                    break
                right = x[rows, tree["feature"][at]] > tree["cut"][at]
                at = np.where(inner, np.where(right, tree["right"][at], tree["left"][at]), at)
            total = total + weight * tree["said"][at]
        if self.way == "vote":
            return total / np.maximum(total.sum(1), 1e-300)[:, None]
        if self.way == "logistic":
            p = 1.0 / (1.0 + np.exp(-2.0 * total))
            return np.stack([1.0 - p, p], 1)
        return (total / len(self.trees) if self.way == "mean" else total)[:, None]

    def column(self, x: Column) -> Column:
        """Array of ``of`` for a column with the array of features."""
        scorer = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, said = np.zeros(0, dtype=np.int64), None
            for b in batches:
                if not len(b):
                    yield pd.Series([], dtype=object)
                    continue
                m = np.stack(b.to_numpy())
                cells, first, place = np.unique(scorer.bins.cell(m), return_index=True, return_inverse=True)
                at = np.searchsorted(known, cells)
                new = (at == len(known)) | (known[np.minimum(at, len(known) - 1)] != cells) if len(known) else np.ones(len(cells), dtype=bool)
                if new.any():
                    got = scorer.of(m[first[new]])
                    known, said = np.concatenate([known, cells[new]]), got if said is None else np.concatenate([said, got])
                    order = np.argsort(known)
                    known, said = known[order], said[order]
                yield pd.Series(list(said[np.searchsorted(known, cells)][place]))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<double>")(x)
