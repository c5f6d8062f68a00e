"""Box tree: what it finds, and that work in many columns follows the number of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import boxtree as B
from tablescope.operators import cluster as C
from tablescope.operators import neighbors as N


def tree_over(x, depth):
    cuts = B.Cuts(depth, *B._split_tree(x, depth))
    regions = cuts.regions(x)
    ids = np.unique(regions)
    low, high = (np.array([f(x[regions == i], axis=0) for i in ids]) for f in (np.min, np.max))
    return cuts, regions, ids, low, high, B.BoxTree.over(depth, x.shape[1], ids, low, high, np.bincount(regions)[ids])


@pytest.mark.parametrize("dims", [1, 3, 9])
def test_reach_and_around_match_all_boxes(dims):
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(c, 0.4, (120, dims)) for c in (0, 3, 9)] + [np.repeat(rng.normal(0, 1, (1, dims)), 60, axis=0)])
    cuts, regions, ids, low, high, tree = tree_over(x, 5)
    limit = rng.uniform(0, 3, len(x))
    rows, found = tree.reach(x - 0.1, x + 0.1, limit)
    gap = np.maximum(np.maximum(low[None] - (x + 0.1)[:, None], (x - 0.1)[:, None] - high[None]), 0)
    want = {(i, ids[j]) for i, j in zip(*np.nonzero(np.sqrt((gap ** 2).sum(-1)) <= limit[:, None]))}
    assert set(zip(rows, found)) == want and len(rows) == len(want)
    sizes = np.bincount(regions, minlength=32)
    for least in (1, 20, 70, 10_000):
        rows, found = tree.around(regions, least)
        assert (np.diff(rows) >= 0).all()
        for i in range(0, len(x), 37):
            mine = found[rows == i]
            assert regions[i] in mine and len(set(mine)) == len(mine)
            assert sizes[mine].sum() >= min(least, len(x))
    assert [list(v) for v in B.lists(np.array([0, 0, 2]), np.array([5, 6, 7]), 4)] == [[5, 6], [], [7], []]


def clustered(spark, folder, dims):
    """Customers in tight groups of 30 far from each other; more customers, more groups."""
    k = F.col("c_custkey")
    group = F.floor(k / 30)
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        (k + 1).alias("_row_id"), *[(group * (7919 + 131 * i) % 10007 + k * (31 + 17 * i) % 13 / 20).alias(f"c{i}") for i in range(dims)])


@pytest.mark.parametrize("dims", [8, 16])
def test_candidate_pairs_in_many_columns_grow_with_the_rows(spark, dims):
    counts = []
    for sf in ("sf0.01", "sf0.1"):
        grid = C._Grid([f"c{i}" for i in range(dims)], 0.9)
        points = grid.points(clustered(spark, f"/root/testdata/{sf}", dims), [f"c{i}" for i in range(dims)], "_row_id")
        cells = C.materialize(grid.boxes(points))
        counts.append((cells.count(), grid.candidates(cells, cells).count()))
    (few, a), (many, b) = counts
    assert many > 9 * few and b <= 1.3 * a * many / few and b < 400 * many


def test_regions_asked_per_row_stay_few(spark):
    """Flags and skewed values: no row asks all regions, also where its own region is short."""
    k = F.col("c_custkey")
    df = spark.read.parquet("/root/testdata/sf0.1/customer.parquet").select(
        (k + 1).alias("_row_id"), (k % 2).cast("double").alias("a"), (k % 7 == 0).cast("double").alias("b"), F.pow(F.col("c_acctbal") / 1000, 3).alias("c"))
    spots = C.materialize(N.places(df, ["a", "b", "c"], "_row_id"))
    xs, per = ["x0", "x1", "x2"], N._REGION_POINTS
    N._REGION_POINTS = 60
    try:
        placed, asked, tree = N._placed(spots.select(F.col("p").alias("q"), *xs), spots, xs)
        start = C.materialize(asked.withColumn("starts", B.regions_around(asked, tree, "region", 11)))
        first = C.materialize(N._search(start.select("q", *xs, F.explode("starts").alias("region")), placed, xs, 10, True))
        more = N._further(start, first, tree, xs, 10).groupBy("q").count()
        rows = start.join(more, "q", "left").select(F.size("starts").alias("s"), F.coalesce("count", F.lit(0)).alias("m")).agg(F.avg("s"), F.avg(F.col("s") + F.col("m"))).first()
    finally:
        N._REGION_POINTS = per
    assert placed.select("region").distinct().count() > 100
    assert rows[0] < 2 and rows[1] < 20
