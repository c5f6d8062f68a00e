"""A tree of boxes over positions: which regions can hold something within reach?"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most regions of a tree; what is broadcast has twice as many boxes.
MAX_REGIONS = 1 << 16
#: Rows sampled for each region to choose the cuts.
_SAMPLED = 16
#: (row, node) pairs looked at together while descending.
_FRONTIER = 200_000


def matrix(series: pd.Series | Sequence[pd.Series]) -> np.ndarray:
    """Rows by columns; a one-column UDF gets a bare series."""
    if isinstance(series, pd.Series):
        series = (series,)
    return np.column_stack([s.to_numpy(dtype=float) for s in series])


def _best_cut(rows: np.ndarray) -> tuple[int, float]:
    """Axis and cut that separate ``rows``: the widest axis whose median leaves about half on
    either side, else the one nearest to that. A median at the maximum (flags, codes) moves
    down to the next smaller value, so a cut always leaves rows on both sides."""
    best, off = (0, float(rows[:, 0].max())), 1.0
    for i in np.argsort(rows.min(axis=0) - rows.max(axis=0), kind="stable"):
        x = rows[:, i]
        at, top = float(np.median(x)), float(x.max())
        if x.min() == top:
            continue
        if at >= top:
            at = float(x[x < top].max())
        away = abs(float(np.mean(x <= at)) - 0.5)
        if away <= 0.15:
            return int(i), at
        if away < off:
            best, off = (int(i), at), away
    return best


def _split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut per node of a complete binary tree over a bounded sample."""
    nodes = (1 << depth) - 1
    axis, cut = np.zeros(nodes, dtype=int), np.full(nodes, -np.inf)
    groups = {0: points}
    for node in range(nodes):
        rows = groups.pop(node)
        if len(rows):
            axis[node], cut[node] = _best_cut(rows)
        below = rows[:, axis[node]] <= cut[node] if len(rows) else np.zeros(0, dtype=bool)
        groups[2 * node + 1], groups[2 * node + 2] = rows[below], rows[~below]
    return axis, cut


def _regions(tree: tuple[np.ndarray, np.ndarray], depth: int, x: np.ndarray) -> np.ndarray:
    axis, cut = tree
    node, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, axis[node]] > cut[node])
    return node - ((1 << depth) - 1)


@dataclass
class Cuts:
    """A complete binary tree of cuts; its leaves are the regions 0 .. 2**depth - 1."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def regions(self, x: np.ndarray) -> np.ndarray:
        return _regions((self.axis, self.cut), self.depth, x)


@dataclass
class BoxTree:
    """Tight boxes and weights of all nodes over the rows really placed in the regions."""

    depth: int
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray

    @classmethod
    def over(cls, depth: int, dims: int, regions: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> BoxTree:
        """From one box and weight for each region that has rows; an empty node is infinitely far."""
        nodes, first = (2 << depth) - 1, (1 << depth) - 1
        lows, highs, weights = np.full((nodes, dims), np.inf), np.full((nodes, dims), -np.inf), np.zeros(nodes)
        lows[first + regions], highs[first + regions], weights[first + regions] = low, high, weight
        for level in range(depth - 1, -1, -1):
            mine = np.arange((1 << level) - 1, (2 << level) - 1)
            left, right = 2 * mine + 1, 2 * mine + 2
            lows[mine], highs[mine] = np.minimum(lows[left], lows[right]), np.maximum(highs[left], highs[right])
            weights[mine] = weights[left] + weights[right]
        return cls(depth, lows, highs, weights)

    def around(self, regions: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, region): the regions with rows under the lowest node that holds a row's own region and weighs ``least``."""
        first = (1 << self.depth) - 1
        node, width = regions + first, np.ones(len(regions), dtype=int)
        while True:
            up = (self.weight[node] < least) & (node > 0)
            if not up.any():
                break
            node[up], width[up] = (node[up] - 1) // 2, 2 * width[up]
        start = (node + 1) * width - 1 - first  # leftmost region below the node
        rows = np.repeat(np.arange(len(regions)), width)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
        asked = start[rows] + within
        some = self.weight[first + asked] > 0
        return rows[some], asked[some]

    def reach(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region): regions whose box is at most ``limit`` from the row's box, by row.

        All rows of a batch go down together, one level a step; a branch too far away ends there.
        """
        found = []
        step = max(1, _FRONTIER >> max(0, self.depth - 6))
        square = (limit * (1 + 1e-12)) ** 2
        for at in range(0, len(low), step):
            rows = np.arange(at, min(len(low), at + step))
            node = np.zeros(len(rows), dtype=int)
            for level in range(self.depth + 1):
                keep = np.concatenate([
                    self._near(low[rows[i:i + _FRONTIER]], high[rows[i:i + _FRONTIER]], square[rows[i:i + _FRONTIER]], node[i:i + _FRONTIER])
                    for i in range(0, len(rows), _FRONTIER)
                ]) if len(rows) else np.zeros(0, dtype=bool)
                rows, node = rows[keep], node[keep]
                if level < self.depth:
                    rows, node = np.repeat(rows, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()
            found.append((rows, node - ((1 << self.depth) - 1)))
        if not found:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])

    def _near(self, low: np.ndarray, high: np.ndarray, square: np.ndarray, node: np.ndarray) -> np.ndarray:
        gap = np.zeros(len(node))
        for i in range(low.shape[1]):
            apart = np.maximum(np.maximum(self.low[node, i] - high[:, i], low[:, i] - self.high[node, i]), 0.0)
            gap += apart * apart
        return gap <= square


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pd.Series:
    """One array of ``values`` for each of ``n`` rows; ``rows`` ascend."""
    return pd.Series(np.split(values, np.searchsorted(rows, np.arange(1, n))), dtype=object) if n else pd.Series([], dtype=object)


def fit_cuts(rows: DataFrame, xs: Sequence[str], key: str, n: int, per_region: int) -> Cuts:
    """Cuts for about ``per_region`` rows a region, at most ``MAX_REGIONS`` regions, from a bounded sample drawn by ``key``."""
    depth = max(0, min(int(math.log2(MAX_REGIONS)), math.ceil(math.log2(max(1.0, n / per_region)))))
    share = min(1.0, 1.5 * _SAMPLED * (1 << depth) / max(1, n))
    some = rows if share >= 1.0 else rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    points = some.select(*xs).toPandas().to_numpy(dtype=float) if depth else np.zeros((0, len(xs)))
    return Cuts(depth, *_split_tree(points, depth))


def region_of(df: DataFrame, cuts: Cuts, xs: Sequence[str]) -> Column:
    """Region of each position."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def region(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(shared.value.regions(matrix(series)))

    return region(*xs)


def build(placed: DataFrame, cuts: Cuts, low: Sequence[str], high: Sequence[str], weight: Column) -> BoxTree:
    """Tree over rows with a ``region``; one row a region is fetched, ``MAX_REGIONS`` at most."""
    boxes = placed.groupBy("region").agg(
        weight.cast("double").alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(low)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(high)]
    ).toPandas()
    dims = len(low)
    lows, highs = boxes[[f"lo{i}" for i in range(dims)]].to_numpy(dtype=float), boxes[[f"hi{i}" for i in range(dims)]].to_numpy(dtype=float)
    return BoxTree.over(cuts.depth, dims, boxes["region"].to_numpy(dtype=int), lows, highs, boxes["n"].to_numpy(dtype=float))


def regions_within(df: DataFrame, tree: BoxTree, low: Sequence[str], high: Sequence[str], limit: Column) -> Column:
    """Array of the regions whose box is at most ``limit`` from the row's box."""
    shared, d = df.sparkSession.sparkContext.broadcast(tree), len(low)

    @F.pandas_udf("array<int>")
    def within(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            rows, regions = shared.value.reach(matrix(series[:d]), matrix(series[d:2 * d]), series[-1].to_numpy(dtype=float))
            order = np.argsort(rows, kind="stable")
            yield lists(rows[order], regions[order], len(series[0]))

    return within(*low, *high, limit)


def regions_around(df: DataFrame, tree: BoxTree, region: str, least: int) -> Column:
    """Array of the regions near the own one that together hold ``least`` rows (all regions if there are fewer rows)."""
    shared = df.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("array<int>")
    def around(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            rows, regions = shared.value.around(own.to_numpy(dtype=int), least)
            yield lists(rows, regions, len(own))

    return around(region)
