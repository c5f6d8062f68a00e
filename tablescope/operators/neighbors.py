"""Distance joins: eps range join, exact k nearest neighbours, nearest centroids."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.operators import boxtree as B
from tablescope.operators.boxtree import _regions, _split_tree, matrix  # noqa: F401  used from here by others
from tablescope.session import materialize, small

# Places per region aimed at.
_REGION_POINTS = 4_000
_CHUNK = 20_000
# Rows on either side of a tile of compared pairs.
_TILE = 1_000
_INLINE_CENTROIDS = 1_000


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        total = total + (x - y) * (x - y)
    return total


def eps_join(df: DataFrame, cols: Sequence[str], eps: float, key: str) -> DataFrame:
    """(left, right, distance) for every pair of rows at most ``eps`` apart, left < right.

    Up to three columns rows meet in neighbouring grid cells of side eps, beyond that in the
    regions of a box tree within eps. A crowded place is cut into tiles of at most about
    ``_TILE`` x ``_TILE`` pairs, dealt by a hash, so no task gets all pairs of a place. The
    result itself grows with density; clustering uses cell summaries instead.
    """
    left, right = _tiles(df, cols, eps, key)
    # plain expressions: folds over arrays are interpreted, which costs more than all else a pair needs
    gap = F.sqrt(squared([F.get("x", F.lit(i)) for i in range(len(cols))], [F.get("y", F.lit(i)) for i in range(len(cols))]))
    pairs = left.join(right, ["place", "part", "tile"]).filter(F.col("left") < F.col("right"))
    return pairs.select("left", "right", gap.alias("distance")).filter(F.col("distance") <= F.lit(eps))


def _tiles(df: DataFrame, cols: Sequence[str], eps: float, key: str) -> tuple[DataFrame, DataFrame]:
    """Left and right rows by (place, part, tile).

    A row lives in one place and visits all places in reach. The rows that live in a place are
    dealt to parts, its visitors to tiles; each visitor goes to all parts, each inhabitant to all
    tiles, so every pair meets once. Places with one part and one tile need no table: only the
    busy ones are joined.
    """
    xs = [f"x{i}" for i in range(len(cols))]
    rows = materialize(df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, xs)]))
    if len(cols) <= 3:
        cell = [F.floor(F.col(n) / F.lit(eps)).cast("bigint") for n in xs]
        offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=len(cols))])
        at_home = rows.withColumn("place", F.array(*cell))
        visits = rows.withColumn("place", F.explode(F.transform(offsets, lambda o: F.zip_with(F.array(*cell), o, lambda a, b: a + b))))
    else:
        cuts = B.fit_cuts(rows, xs, "key", rows.count(), _TILE // 4)
        at_home = materialize(rows.withColumn("place", B.region_of(rows, cuts, xs)))
        tree = B.build(at_home.withColumnRenamed("place", "region"), cuts, xs, xs, F.count(F.lit(1)))
        visits = rows.withColumn("place", F.explode(B.regions_within(rows, tree, xs, xs, F.lit(float(eps)))))
    living = at_home.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / _TILE).cast("int").alias("parts"))
    visiting = visits.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / _TILE).cast("int").alias("tiles"))
    busy = small(materialize(living.join(visiting, "place").filter((F.col("parts") > 1) | (F.col("tiles") > 1))))

    def dealt(kind: str) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(kind)), F.col(kind)).cast("int")

    def sized(table: DataFrame) -> DataFrame:
        return table.join(busy, "place", "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "tiles": F.coalesce("tiles", F.lit(1))})

    every = lambda kind: F.explode(F.sequence(F.lit(0), F.col(kind) - 1))
    left = sized(visits).select(F.col("key").alias("left"), F.array(*xs).alias("x"), "place", dealt("tiles").alias("tile"), every("parts").alias("part"))
    right = sized(at_home).select(F.col("key").alias("right"), F.array(*xs).alias("y"), "place", dealt("parts").alias("part"), every("tiles").alias("tile"))
    return left, right


def nearest(queries: DataFrame, data: DataFrame, dims: int, k: int, exclude_self: bool) -> DataFrame:
    """Exact k nearest ``data`` places for every query.

    ``queries``: (q, x0..); ``data``: (p, first, w, x0..) where ``w`` rows share a place and
    ``first`` breaks ties. Returns (q, p, distance, take): how many rows of place p belong
    to the k nearest. Space is cut into regions of a few thousand places by a tree from a
    sample. A query first searches its own region, with as many regions beside it as hold k
    rows; the k-th distance found there then bounds a descent of the tree, and only regions
    whose box is closer are searched besides, in chunks of bounded size.
    """
    xs = [f"x{i}" for i in range(dims)]
    placed, asked, tree = _placed(queries, data, xs)
    start = asked.withColumn("starts", B.regions_around(asked, tree, "region", k + int(exclude_self)))
    start = materialize(start)
    first = materialize(_search(start.select("q", *xs, F.explode("starts").alias("region")), placed, xs, k, exclude_self))
    more = _search(_further(start, first, tree, xs, k), placed, xs, k, exclude_self)
    both = first.unionByName(more)
    order = W.partitionBy("q").orderBy("distance", "first")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = both.withColumn("_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    return ranked.filter(F.col("_before") < k).select("q", "p", "distance", F.least(F.col("w"), F.lit(k) - F.col("_before")).alias("take"))


def _placed(queries: DataFrame, data: DataFrame, xs: list[str]) -> tuple[DataFrame, DataFrame, B.BoxTree]:
    """Places and queries with their regions, and the tree over the places."""
    cuts = B.fit_cuts(data, xs, "p", data.count(), _REGION_POINTS)
    placed = materialize(data.withColumn("region", B.region_of(data, cuts, xs)))
    return placed, queries.withColumn("region", B.region_of(queries, cuts, xs)), B.build(placed, cuts, xs, xs, F.sum("w"))


def _further(start: DataFrame, first: DataFrame, tree: B.BoxTree, xs: list[str], k: int) -> DataFrame:
    """(q, x.., region): regions not searched yet that are closer than the k-th distance found.

    Where fewer than k rows were found, the search has been everywhere.
    """
    order = W.partitionBy("q").orderBy("distance", "first")
    upto = F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1))
    kth = first.withColumn("_before", F.coalesce(upto, F.lit(0))).filter(F.col("_before") < k).groupBy("q").agg(F.max("distance").alias("bound"))
    bound = start.join(kth, "q")
    asked = bound.withColumn("regions", B.regions_within(bound, tree, xs, xs, F.col("bound")))
    return asked.select("q", *xs, F.explode(F.array_except("regions", "starts")).alias("region"))


def _search(asked: DataFrame, placed: DataFrame, xs: list[str], k: int, exclude_self: bool) -> DataFrame:
    """Best hits of each query inside the region it asks for, region by region and chunk by chunk."""
    spread = asked.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(1 << 20)))
    load = asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(_CHUNK)).cast("int").alias("chunks"))
    rows = load.collect()  # one row per region, at most B.MAX_REGIONS

    def chunks(name: str) -> DataFrame:
        return F.broadcast(asked.sparkSession.createDataFrame(rows, f"region int, {name} int"))

    queries = spread.join(chunks("parts"), "region").withColumn("chunk", F.pmod("chunk", F.col("parts")).cast("int"))
    data = placed.join(chunks("copies"), "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "p", "distance", "first", "w"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns})
        right = right.sort_values("first", kind="stable")
        y, p = right[xs].to_numpy(dtype=float), right["p"].to_numpy()
        w, first = right["w"].to_numpy().copy(), right["first"].to_numpy()
        out = []
        step = max(1, 4_000_000 // len(y))
        want = min(len(y), k + 1)
        for at in range(0, len(left), step):
            part = left.iloc[at:at + step]
            x, q = part[xs].to_numpy(dtype=float), part["q"].to_numpy()
            d = np.zeros((len(x), len(y)))
            for i in range(len(xs)):
                d += np.square(x[:, i:i + 1] - y[:, i])
            cut = np.partition(d, want - 1, axis=1)[:, want - 1]
            row, col = np.nonzero(d <= cut[:, None])  # ties at the cut stay in
            weight = w[col]
            if exclude_self:
                weight = weight - (q[row] == p[col])
            keep = weight > 0
            out.append(pd.DataFrame({
                "q": q[row][keep], "p": p[col][keep], "distance": np.sqrt(d[row, col][keep]), "first": first[col][keep], "w": weight[keep],
            }))
        return pd.concat(out)

    grouped = queries.groupBy("region", "chunk").cogroup(data.groupBy("region", "chunk"))
    kinds = dict(asked.dtypes)["q"]
    return grouped.applyInPandas(run, f"q {kinds}, p bigint, distance double, first bigint, w bigint")


def places(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Distinct positions (p = first = smallest key there, w rows): copies are one place."""
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    return df.select(F.col(key).cast("bigint").alias("k"), *x).groupBy(*[f"x{i}" for i in range(len(cols))]).agg(
        F.min("k").alias("p"), F.count(F.lit(1)).alias("w")
    ).withColumn("first", F.col("p"))


def knn_places(df: DataFrame, cols: Sequence[str], k: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(places, neighbours of one row at each place)."""
    spots = materialize(places(df, cols, key))
    queries = spots.select(F.col("p").alias("q"), *[f"x{i}" for i in range(len(cols))])
    return spots, nearest(queries, spots, len(cols), k, exclude_self=True)


def knn_join(df: DataFrame, cols: Sequence[str], k: int, key: str) -> DataFrame:
    """(key, neighbor, distance, rank): the k nearest other rows, exact.

    Ties go to the place with the smallest key, then to the smaller key.
    """
    spots, near = knn_places(df, cols, k, key)
    near = materialize(near)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    xs = [f"x{i}" for i in range(len(cols))]
    members = materialize(df.select(F.col(key).cast("bigint").alias("k"), *x).join(spots.select("p", *xs), xs).select("p", "k"))
    # the first k+1 keys of each place, in two steps so that a crowded place is not sorted at once
    part = members.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(W.partitionBy("p", "salt").orderBy("k"))).filter(F.col("r") <= k + 1)
    heads = part.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("k"))).filter(F.col("r") <= k + 1).select("p", F.col("k").alias("neighbor"))
    rows = members.withColumnRenamed("p", "q").join(near, "q").join(heads, "p").filter(F.col("neighbor") != F.col("k"))
    inside = W.partitionBy("k", "p").orderBy("neighbor")
    rows = rows.withColumn("_i", F.row_number().over(inside)).filter(F.col("_i") <= F.col("take"))
    order = W.partitionBy("k").orderBy("distance", "p", "neighbor")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).select(F.col("k").alias(key), "neighbor", "distance", "rank")


def local_outlier_factor(df: DataFrame, cols: Sequence[str], k: int, key: str, out: str = "_raw_score") -> DataFrame:
    """``df`` plus the local outlier factor of each row, from its k nearest other rows."""
    spots, near = knn_places(df, cols, k, key)
    near = materialize(near)
    reach = near.groupBy("q").agg(F.max("distance").alias("kd"))
    dense = near.join(reach.withColumnRenamed("q", "p"), "p").groupBy("q").agg(
        (F.lit(1.0) / (F.sum(F.greatest("kd", "distance") * F.col("take")) / F.sum("take") + F.lit(1e-10))).alias("lrd")
    )
    dense = materialize(dense)
    factor = near.join(dense.select(F.col("q").alias("p"), F.col("lrd").alias("other")), "p").join(dense, "q").groupBy("q").agg(
        (F.sum(F.col("other") * F.col("take")) / F.sum("take") / F.first("lrd")).alias(out)
    )
    xs = [f"x{i}" for i in range(len(cols))]
    scored = spots.select("p", *xs).join(factor.withColumnRenamed("q", "p"), "p").drop("p")
    return df.withColumns({f"x{i}": F.col(c).cast("double") for i, c in enumerate(cols)}).join(scored, xs, "left").drop(*xs)


def centroids(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, size, center): mean vector per cluster."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.col(c).cast("double")) for c in cols]).alias("center")
    )


def nearest_centroid(df: DataFrame, centers: DataFrame, cols: Sequence[str], key: str, own: str | None = None) -> DataFrame:
    """``df`` plus ``_nearest``, ``_nearest_distance``, ``_second``, ``_second_distance``.

    ``centers``: (cluster, center). With ``own``, a row's own cluster is left out. Few
    centroids are carried to the rows as one checked array; many are searched by region.
    """
    rows = centers.select("cluster", "center").limit(_INLINE_CENTROIDS + 1).collect()
    kind = dict(centers.dtypes)["cluster"]
    spark = df.sparkSession
    if len(rows) <= _INLINE_CENTROIDS:
        listed = spark.createDataFrame([(1, [(r["cluster"], r["center"]) for r in rows])], f"_one int, _c array<struct<cluster:{kind},center:array<double>>>")
        x = F.array(*[F.col(c).cast("double") for c in cols])

        def gap(s: Column) -> Column:
            return F.sqrt(F.aggregate(F.zip_with(x, s["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))

        allowed = F.col("_c") if own is None else F.filter("_c", lambda s: ~s["cluster"].eqNullSafe(F.col(own)))
        best = F.array_sort(F.transform(allowed, lambda s: F.struct(gap(s).alias("d"), s["cluster"].alias("c"))))
        out = df.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").withColumn("_best", F.slice(best, 1, 2))
        first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
        return out.withColumns({
            "_nearest": first["c"], "_nearest_distance": first["d"], "_second": second["c"], "_second_distance": second["d"],
        }).drop("_one", "_c", "_best")
    from tablescope.operators.ordering import number_rows

    numbered = materialize(number_rows(centers.select("cluster", "center"), ["cluster"], "p"))
    data = numbered.select("p", F.col("p").alias("first"), F.lit(1).cast("bigint").alias("w"), *[F.col("center")[i].alias(f"x{i}") for i in range(len(cols))])
    queries = df.select(F.col(key).alias("q"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    want = 2 if own is None else 3
    near = nearest(queries, data, len(cols), want, exclude_self=False).join(numbered.select("p", "cluster"), "p")
    near = near.join(df.select(F.col(key).alias("q"), *([F.col(own).alias("_own")] if own else [])), "q")
    if own:
        near = near.filter(~F.col("cluster").eqNullSafe(F.col("_own")))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("distance", "p")))
    picked = near.groupBy("q").agg(*[
        F.max(F.when(F.col("r") == i, F.col(c))).alias(a)
        for i, c, a in ((1, "cluster", "_nearest"), (1, "distance", "_nearest_distance"), (2, "cluster", "_second"), (2, "distance", "_second_distance"))
    ])
    return df.join(picked.withColumnRenamed("q", key), key, "left")
