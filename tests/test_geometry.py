"""Grid and tree algorithms against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import cluster as C
from tablescope.operators import neighbors as N
from tablescope.operators.components import connected_components


def scan_dbscan(x, eps, m):
    """Textbook sequential scan."""
    n = len(x)
    near = [[j for j in range(n) if math.dist(x[i], x[j]) <= eps] for i in range(n)]
    label, c = [None] * n, 0
    for i in range(n):
        if label[i] is not None or len(near[i]) < m:
            continue
        todo = [i]
        while todo:
            p = todo.pop()
            if label[p] is None:
                label[p] = c
                if len(near[p]) >= m:
                    todo += [q for q in near[p] if label[q] is None]
        c += 1
    return [-1 if v is None else v for v in label]


def frame(spark, x):
    cols = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(x)], "_row_id long, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize("d,eps,m,direct", [(1, 0.3, 3, 4096), (2, 0.5, 4, 4096), (2, 0.45, 5, 1), (3, 0.9, 6, 2), (5, 1.4, 4, 4096)])
def test_dbscan_equals_scan(spark, monkeypatch, d, eps, m, direct):
    monkeypatch.setattr(C, "DIRECT_PAIRS", direct)
    rng = np.random.default_rng(d * 10 + m)
    x = np.vstack([rng.normal(c, 0.6, size=(45, d)) for c in (0.0, 1.9, 4.0)] + [rng.uniform(-3, 7, size=(25, d))])
    x = np.vstack([x, np.repeat(x[:1], 12, axis=0)])[rng.permutation(len(x) + 12)]
    df, cols = frame(spark, x)
    got = {r["_row_id"]: r["_cluster"] for r in C.dbscan(df, cols, "_row_id", eps, m).collect()}
    want = scan_dbscan(x, eps, m)
    assert [got[i + 1] for i in range(len(x))] == want
    assert len(set(want)) > 2


def test_knn_and_lof_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "_REGION_POINTS", 20)
    monkeypatch.setattr(N, "_CHUNK", 15)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, size=(150, 2)), rng.normal(5, 0.2, size=(50, 2))])
    x = np.vstack([x, np.repeat(x[3:4], 9, axis=0)])
    df, cols = frame(spark, x)
    k, n = 5, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    first = {tuple(r): i for i, r in reversed(list(enumerate(x.tolist())))}
    place = [first[tuple(r)] for r in x.tolist()]
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], place[j], j))[:k] for i in range(n)]
    got = {}
    for r in N.knn_join(df, cols, k, "_row_id").collect():
        got.setdefault(r["_row_id"] - 1, {})[r["rank"]] = r["neighbor"] - 1
    assert all([got[i][r] for r in range(1, k + 1)] == near[i] for i in range(n))
    kd = [d[i, near[i][-1]] for i in range(n)]
    lrd = [1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)]
    lof = [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)]
    scored = {r["_row_id"] - 1: r["_raw_score"] for r in N.local_outlier_factor(df, cols, k, "_row_id").collect()}
    assert np.allclose([scored[i] for i in range(n)], lof, rtol=1e-6)


def test_eps_join(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 3, size=(80, 4))
    df, cols = frame(spark, x)
    got = {(r.left, r.right) for r in N.eps_join(df, cols, 0.8, "_row_id").collect()}
    assert got == {(i + 1, j + 1) for i in range(80) for j in range(i + 1, 80) if math.dist(x[i], x[j]) <= 0.8}


@pytest.mark.parametrize("dims", [2, 5])
def test_eps_join_splits_a_crowded_place(spark, monkeypatch, dims):
    """Half of all rows in one cell: all pairs are found and no task has more than twice the median."""
    monkeypatch.setattr(N, "_TILE", 20)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.uniform(0, 0.4, size=(300, dims)), rng.uniform(0, 40, size=(300, dims))])
    df, cols = frame(spark, x)
    got = {(r.left, r.right) for r in N.eps_join(df, cols, 0.5, "_row_id").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert got == {(i + 1, j + 1) for i, j in zip(*np.nonzero(np.triu(d <= 0.5, 1)))}
    left, right = N._tiles(df, cols, 0.5, "_row_id")
    met = left.join(right, ["place", "part", "tile"])
    assert met.groupBy("place", "part", "tile").count().agg(F.max("count")).first()[0] <= 40 * 40
    tasks = sorted(r["count"] for r in met.groupBy(F.pmod(F.hash("place", "part", "tile"), F.lit(8)).alias("task")).count().collect())
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]


@pytest.mark.parametrize("inline", [1000, 3])
def test_nearest_centroid(spark, monkeypatch, inline):
    monkeypatch.setattr(N, "_INLINE_CENTROIDS", inline)
    rng = np.random.default_rng(9)
    x, c = rng.uniform(0, 9, size=(60, 2)), rng.uniform(0, 9, size=(7, 2))
    df, cols = frame(spark, x)
    df = df.withColumn("own", (F.col("_row_id") % 7).cast("int"))
    centers = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(c)], "cluster int, center array<double>")
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))
    for own in (None, "own"):
        for r in N.nearest_centroid(df, centers, cols, "_row_id", own).collect():
            order = [j for j in np.argsort(d[r["_row_id"] - 1]) if own is None or j != r["own"]]
            assert (r["_nearest"], r["_second"]) == (order[0], order[1])
            assert abs(r["_nearest_distance"] - d[r["_row_id"] - 1, order[0]]) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (53, 51)]
    e = spark.createDataFrame([(str(a).zfill(3), str(b).zfill(3)) for a, b in edges], "a string, b string")
    nodes = spark.createDataFrame([(str(i).zfill(3),) for i in range(1, 61)], "node string")
    got = {int(r.node): int(r.component) for r in connected_components(nodes, e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[53] == 50 and got[60] == 60


def test_regions_split_on_flags():
    import numpy as np

    from tablescope.operators.neighbors import _regions, _split_tree

    rng = np.random.default_rng(1)
    for extra in (1, 3):
        x = np.column_stack([(rng.random(20_000) < 0.6).astype(float), *[rng.random(20_000) for _ in range(extra)]])
        held = np.bincount(_regions(_split_tree(x[:4000], 6), 6, x), minlength=64)
        assert held.max() <= 2 * 20_000 / 64
