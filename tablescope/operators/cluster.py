"""Clustering: DBSCAN from grid summaries, k-means, and the columns derived from clusters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.values import present
from tablescope.operators import boxtree as B
from tablescope.operators.components import connected_components
from tablescope.operators.neighbors import centroids, nearest_centroid, squared
from tablescope.operators.ordering import number_rows
from tablescope.session import materialize, small

# Defaults, decisions and reasons of the cluster review.
EPS = 0.8
LIKELY_OUTLIER, MERGE, MANUAL = "likely_outlier", "merge_with_nearest_cluster", "review_manually"
REASON_SMALL = "Small isolated cluster may be unstable for learning."
REASON_DIFFERS = "Cluster differs mainly on "
REASON_MANUAL = "Cluster needs manual inspection."

# Piece pairs with at most this many point pairs are compared point by point.
DIRECT_PAIRS = 4_096
# Occupied cells per region of the tree aimed at.
REGION_CELLS = 64
_MAX_LEVEL = 40
_SLACK = 1e-12


def default_min_samples(n: int) -> int:
    return max(2, min(10, n // 20))


def small_cluster_size(n: int) -> int:
    return max(3, n // 20)


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


class _Grid:
    """Points in cells whose diagonal is eps: rows of one cell are always neighbours."""

    def __init__(self, cols: Sequence[str], eps: float):
        self.d = len(cols)
        self.eps = eps
        self.side = eps / math.sqrt(self.d) * (1.0 - 1e-9)
        self.x = [f"x{i}" for i in range(self.d)]
        self.lo = [f"lo{i}" for i in range(self.d)]
        self.hi = [f"hi{i}" for i in range(self.d)]
        self.lead = min(3, self.d)
        self.reach = math.ceil(math.sqrt(self.d))
        self.limit = eps * eps * (1.0 + _SLACK)

    def points(self, df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
        x = [F.col(c).cast("double").alias(n) for c, n in zip(cols, self.x)]
        at = [F.floor(F.col(n) / F.lit(self.side)).cast("bigint").alias(f"g{i}") for i, n in enumerate(self.x)]
        placed = df.select(F.col(key).cast("bigint").alias("k"), *x).select("*", *at)
        cell = F.concat_ws(",", *[F.col(f"g{i}").cast("string") for i in range(self.d)])
        return placed.withColumn("cell", cell)

    def boxes(self, points: DataFrame, *by: str) -> DataFrame:
        return points.groupBy("cell", *by).agg(
            F.count(F.lit(1)).alias("n"), F.min("k").alias("first"),
            *[F.min(c).alias(a) for c, a in zip(self.x, self.lo)], *[F.max(c).alias(a) for c, a in zip(self.x, self.hi)],
            *[F.first(f"g{i}").alias(f"g{i}") for i in range(self.d)],
        )

    def box_gaps(self, a: str, b: str) -> tuple[Column, Column]:
        """Squared smallest and largest distance of two boxes with column prefixes a and b."""
        near, far = [], []
        for lo, hi in zip(self.lo, self.hi):
            gap = F.greatest(F.col(a + lo) - F.col(b + hi), F.col(b + lo) - F.col(a + hi), F.lit(0.0))
            span = F.greatest(F.col(a + hi) - F.col(b + lo), F.col(b + hi) - F.col(a + lo))
            near.append(gap * gap)
            far.append(span * span)
        return _sum(near), _sum(far)

    def point_gaps(self, b: str) -> tuple[Column, Column]:
        near, far = [], []
        for x, lo, hi in zip(self.x, self.lo, self.hi):
            gap = F.greatest(F.col(b + lo) - F.col(x), F.col(x) - F.col(b + hi), F.lit(0.0))
            span = F.greatest(F.col(x) - F.col(b + lo), F.col(b + hi) - F.col(x))
            near.append(gap * gap)
            far.append(span * span)
        return _sum(near), _sum(far)

    def prefixed(self, boxes: DataFrame, p: str) -> DataFrame:
        return boxes.select(*[F.col(c).alias(p + c) for c in ("cell", "n", *self.lo, *self.hi, *[f"g{i}" for i in range(self.d)])])

    def near_cells(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of different cells whose boxes are within eps; columns a_*, b_*."""
        pairs = self.candidates(left, right).filter(F.col("a_cell") != F.col("b_cell"))
        near, far = self.box_gaps("a_", "b_")
        return pairs.withColumns({"near": near, "far": far}).filter(F.col("near") <= self.limit)

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of cells whose boxes are then compared.

        Up to three columns: cells at most ``reach`` steps apart on every axis. Beyond that steps
        on three axes say little and steps on all are too many: a tree of boxes over the
        cells sends each left cell to the regions whose tight box is within eps of it.
        """
        return self._by_steps(left, right) if self.d <= self.lead else self._by_tree(left, right)

    def _by_tree(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = self.prefixed(left, "a_"), self.prefixed(right, "b_")
        low, high = ["b_" + c for c in self.lo], ["b_" + c for c in self.hi]
        cuts = B.fit_cuts(right, self.lo, "cell", right.count(), REGION_CELLS)
        b = materialize(b.withColumn("region", B.region_of(b, cuts, low)))
        tree = B.build(b, cuts, low, high, F.count(F.lit(1)))
        within = B.regions_within(a, tree, ["a_" + c for c in self.lo], ["a_" + c for c in self.hi], F.lit(self.eps))
        return a.withColumn("region", F.explode(within)).join(b, "region").drop("region")

    def _by_steps(self, left: DataFrame, right: DataFrame) -> DataFrame:
        steps = range(-self.reach, self.reach + 1)
        offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product(steps, repeat=self.lead)])
        a = self.prefixed(left, "a_").withColumn("o", F.explode(offsets))
        a = a.withColumns({f"m{i}": F.col(f"a_g{i}") + F.col("o")[i] for i in range(self.lead)}).drop("o")
        b = self.prefixed(right, "b_").withColumns({f"m{i}": F.col(f"b_g{i}") for i in range(self.lead)})
        return a.join(b, [f"m{i}" for i in range(self.lead)])


def _touching(grid: _Grid, asking: DataFrame, cells: DataFrame, points: DataFrame, extra: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Split (point, near cell) into cells fully within eps, and single points within eps.

    ``asking`` are the points of sparse cells, so the points compared with one crowded cell
    stay few; ``extra`` names columns of ``points`` kept on single hits.
    """
    owners = asking.select("cell", *[f"g{i}" for i in range(grid.d)]).distinct()
    bare = owners.withColumns({
        "n": F.lit(0).cast("bigint"),
        **{lo: F.col(f"g{i}") * F.lit(grid.side) for i, lo in enumerate(grid.lo)},
        **{hi: (F.col(f"g{i}") + 1) * F.lit(grid.side) for i, hi in enumerate(grid.hi)},
    })
    pairs = grid.near_cells(bare, cells).select(F.col("a_cell").alias("cell"), "b_cell", "b_n", *[f"b_{c}" for c in (*grid.lo, *grid.hi)])
    near, far = grid.point_gaps("b_")
    met = materialize(asking.select("k", "cell", *grid.x).join(pairs, "cell").withColumns({"near": near, "far": far}).filter(F.col("near") <= grid.limit))
    whole = met.filter(F.col("far") <= grid.eps * grid.eps).select("k", "b_cell", "b_n")
    partly = met.filter(F.col("far") > grid.eps * grid.eps).select("k", "b_cell", *[F.col(c).alias(f"q{i}") for i, c in enumerate(grid.x)])
    gap = squared([F.col(f"q{i}") for i in range(grid.d)], [F.col(c) for c in grid.x])
    other = points.select(F.col("cell").alias("b_cell"), F.col("k").alias("k2"), *grid.x, *extra)
    single = partly.join(other, "b_cell").filter(F.sqrt(gap) <= grid.eps)
    return whole, single


def core_points(df: DataFrame, cols: Sequence[str], key: str, eps: float = EPS, min_samples: int | None = None) -> DataFrame:
    """(key, is_core): at least ``min_samples`` rows, itself included, within ``eps``."""
    n = min_samples or default_min_samples(df.count())
    grid = _Grid(cols, eps)
    points = materialize(grid.points(df, cols, key))
    return _core(grid, points, n).select(F.col("k").alias(key), "is_core")


def _core(grid: _Grid, points: DataFrame, min_samples: int) -> DataFrame:
    """Points with ``is_core``. Cells holding ``min_samples`` rows need no distances at all."""
    cells = materialize(grid.boxes(points))
    sized = points.join(cells.select("cell", "n"), "cell")
    sparse = materialize(sized.filter(F.col("n") < min_samples))
    whole, single = _touching(grid, sparse, cells, points, [])
    counted = whole.select("k", F.col("b_n").alias("c")).unionByName(single.groupBy("k").agg(F.count(F.lit(1)).alias("c")))
    more = counted.groupBy("k").agg(F.sum("c").alias("c"))
    decided = sparse.join(more, "k", "left").withColumn("is_core", F.col("n") + F.coalesce("c", F.lit(0)) >= min_samples).drop("c", "n")
    crowded = sized.filter(F.col("n") >= min_samples).withColumn("is_core", F.lit(True)).drop("n")
    return materialize(crowded.unionByName(decided.select(*crowded.columns)))


def _linked_cells(grid: _Grid, core: DataFrame) -> DataFrame:
    """(a, b): pairs of core cells with two core points within eps.

    Boxes decide most pairs. The others are cut into ever smaller pieces, keeping only
    piece pairs their boxes leave open, until few enough point pairs remain to compare.
    """
    cells = materialize(grid.boxes(core))
    pairs = materialize(grid.near_cells(cells, cells).filter(F.col("a_cell") < F.col("b_cell")))
    limit = grid.eps * grid.eps
    linked = [pairs.filter(F.col("far") <= limit).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))]
    size = F.col("a_n") * F.col("b_n")
    undecided = pairs.filter(F.col("far") > limit).select(
        F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), F.lit("").alias("pa"), F.lit("").alias("pb"), size.alias("size")
    )
    level, piece = 0, F.lit("")
    while True:
        undecided = materialize(undecided)
        last = level >= _MAX_LEVEL
        tagged = core.withColumn("piece", piece)
        direct = undecided if last else undecided.filter(F.col("size") <= DIRECT_PAIRS)
        left = tagged.select(F.col("cell").alias("a"), F.col("piece").alias("pa"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(grid.x)])
        right = tagged.select(F.col("cell").alias("b"), F.col("piece").alias("pb"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(grid.x)])
        gap = squared([F.col(f"p{i}") for i in range(grid.d)], [F.col(f"q{i}") for i in range(grid.d)])
        hits = direct.join(left, ["a", "pa"]).join(right, ["b", "pb"]).filter(F.sqrt(gap) <= grid.eps).select("a", "b").distinct()
        found = materialize(hits)
        linked.append(found)
        rest = undecided.filter(F.col("size") > DIRECT_PAIRS).join(found, ["a", "b"], "left_anti")
        if last or rest.isEmpty():
            return reduce(DataFrame.unionByName, linked).distinct()
        level += 1
        step = grid.side / (1 << level)
        inner = F.concat_ws(",", *[F.floor((F.col(c) - F.col(f"g{i}") * F.lit(grid.side)) / F.lit(step)).cast("bigint").cast("string") for i, c in enumerate(grid.x)])
        pieces = grid.boxes(tagged.withColumnRenamed("piece", "parent").withColumn("piece", inner), "parent", "piece")
        box = ["n", *grid.lo, *grid.hi]
        a = pieces.select(F.col("cell").alias("a"), F.col("parent").alias("pa"), F.col("piece").alias("ca"), *[F.col(c).alias("a_" + c) for c in box])
        b = pieces.select(F.col("cell").alias("b"), F.col("parent").alias("pb"), F.col("piece").alias("cb"), *[F.col(c).alias("b_" + c) for c in box])
        near, far = grid.box_gaps("a_", "b_")
        open_ = materialize(rest.join(a, ["a", "pa"]).join(b, ["b", "pb"]).withColumns({"near": near, "far": far}).filter(F.col("near") <= grid.limit).select(
            "a", "b", F.col("ca").alias("pa"), F.col("cb").alias("pb"), size.alias("size"), "far"
        ))
        sure = open_.filter(F.col("far") <= limit).select("a", "b").distinct()
        linked.append(sure)
        undecided = open_.drop("far").join(sure, ["a", "b"], "left_anti")
        piece = inner


def dbscan(
    df: DataFrame, cols: Sequence[str], key: str = "_row_id", eps: float = EPS, min_samples: int | None = None, out: str = "_cluster",
) -> DataFrame:
    """``df`` plus a cluster number, -1 for noise; numbers follow the first core row by ``key``.

    A border row joins the smallest cluster it touches, as a scan in row order would do.
    Work and shuffles follow the number of rows and occupied cells, not pairs of rows.
    """
    n = min_samples or default_min_samples(df.count())
    grid = _Grid(cols, eps)
    points = materialize(grid.points(df, cols, key))
    marked = _core(grid, points, n)
    core = materialize(marked.filter("is_core").drop("is_core"))
    cells = materialize(grid.boxes(core))
    parts = connected_components(cells.select(F.col("cell").alias("node")), _linked_cells(grid, core))
    cells = cells.join(parts.withColumnRenamed("node", "cell"), "cell")
    starts = cells.groupBy("component").agg(F.min("first").alias("first"))
    numbered = number_rows(starts, ["first"], "number").select("component", (F.col("number") - 1).cast("int").alias(out))
    labelled = materialize(cells.join(numbered, "component").drop("component"))
    own = labelled.select("cell", out)
    inside = core.join(own, "cell").select("k", out)
    border = materialize(marked.filter(~F.col("is_core")).drop("is_core"))
    whole, single = _touching(grid, border, labelled, core.join(own, "cell"), [F.col(out)])
    touched = (
        border.join(own, "cell").select("k", out)
        .unionByName(whole.join(own.withColumnRenamed("cell", "b_cell"), "b_cell").select("k", out))
        .unionByName(single.select("k", out))
    ).groupBy("k").agg(F.min(out).alias(out))
    labels = inside.unionByName(touched).withColumnRenamed("k", key)
    return df.join(labels, key, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def kmeans(df: DataFrame, cols: Sequence[str], k: int | None = None, out: str = "_cluster", seed: int = 42) -> DataFrame:
    """``df`` plus cluster number and ``_distance_to_centroid``; k defaults to sqrt(n) within 2..8."""
    n = df.count()
    k = max(1, min(k or max(2, min(8, int(math.sqrt(max(1, n))))), n))
    x = [F.col(c).cast("double") for c in cols]
    rows = df.withColumn("_v", array_to_vector(F.array(*x)))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out, initMode="k-means||").fit(rows)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    mine = F.element_at(centers, F.col(out) + 1)
    gap = F.sqrt(_sum([(x[i] - mine[i]) * (x[i] - mine[i]) for i in range(len(x))]))
    return model.transform(rows).withColumn("_distance_to_centroid", gap).drop("_v")


def cluster_sizes(df: DataFrame, cluster: str = "_cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_cluster_size"))


def _with_sizes(df: DataFrame, cluster: str) -> tuple[DataFrame, int]:
    sizes = small(cluster_sizes(df, cluster))
    total = sizes.agg(F.coalesce(F.sum("_cluster_size"), F.lit(0))).first()[0]
    return df.join(sizes, cluster, "left"), total


def cluster_name(cluster: Column) -> Column:
    return F.when(cluster == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster_"), cluster.cast("string")))


def distance_to_centroid(df: DataFrame, cols: Sequence[str], cluster: str = "_cluster", key: str = "_row_id") -> DataFrame:
    """Distance to the own centroid; noise rows measure to the nearest one, 0 if there is none."""
    centers = materialize(centroids(df.filter(F.col(cluster) != -1), cols, cluster))
    mine = small(centers.select(F.col("cluster").alias(cluster), F.col("center").alias("_own")))
    out = df.join(mine, cluster, "left")
    if centers.isEmpty():
        return out.withColumn("_distance_to_centroid", F.lit(0.0)).drop("_own")
    own = F.sqrt(_sum([(F.col(c) - F.col("_own")[i]) * (F.col(c) - F.col("_own")[i]) for i, c in enumerate(cols)]))
    known = out.filter(F.col(cluster) != -1).withColumn("_distance_to_centroid", own).drop("_own")
    stray = nearest_centroid(out.filter(F.col(cluster) == -1).drop("_own"), centers, cols, key)
    stray = stray.withColumn("_distance_to_centroid", F.col("_nearest_distance")).select(*known.columns)
    return known.unionByName(stray)


def cluster_columns(df: DataFrame, cluster: str = "_cluster") -> DataFrame:
    """_cluster_id, _cluster_size, _is_noise, _is_small_cluster."""
    sized, n = _with_sizes(df, cluster)
    c = F.col(cluster)
    return sized.withColumns({
        "_cluster_id": cluster_name(c), "_is_noise": c == -1,
        "_is_small_cluster": (F.col("_cluster_size") <= small_cluster_size(n)) | (c == -1),
    })


def cluster_metrics(df: DataFrame, cluster: str = "_cluster") -> DataFrame:
    """(metric, value): clusters, noise rows, noise share, small clusters."""
    sizes = cluster_sizes(df, cluster)
    real = F.col(cluster) != -1
    n = sizes.agg(F.coalesce(F.sum("_cluster_size"), F.lit(0))).first()[0]
    wide = sizes.agg(
        F.count_if(real).cast("double").alias("cluster_count"),
        F.coalesce(F.sum(F.when(~real, F.col("_cluster_size"))), F.lit(0)).cast("double").alias("noise_count"),
        F.count_if(real & (F.col("_cluster_size") <= small_cluster_size(n))).cast("double").alias("small_cluster_count"),
    ).withColumn("noise_ratio", F.col("noise_count") / F.lit(float(max(1, n))))
    names = ["cluster_count", "noise_count", "noise_ratio", "small_cluster_count"]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))


def island_columns(df: DataFrame, cluster: str = "_cluster") -> DataFrame:
    """_cluster_id, _is_island (small or noise), _is_outlier (noise), and the cluster size."""
    return cluster_columns(df, cluster).withColumnRenamed("_is_small_cluster", "_is_island").withColumnRenamed("_is_noise", "_is_outlier")


def majority_class(df: DataFrame, label: str, cluster: str = "_cluster") -> DataFrame:
    """(cluster, majority): most frequent label per cluster, ties to the smallest."""
    counts = df.filter(F.col(cluster) != -1).select(F.col(cluster).alias("cluster"), present(df, label).alias("v")).filter(F.col("v").isNotNull())
    counted = counts.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("cluster").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("majority"))


def nearest_major_class(df: DataFrame, cols: Sequence[str], cluster: str = "_cluster", label: str | None = None, key: str = "_row_id") -> DataFrame:
    """``_nearest_major_class``: majority label of the nearest other cluster.

    Noise looks at all clusters; a single cluster stands for itself. Without a label the
    cluster name is given.
    """
    centers = materialize(centroids(df.filter(F.col(cluster) != -1), cols, cluster))
    if centers.isEmpty():
        return df.withColumn("_nearest_major_class", F.lit(None).cast("string") if label else F.lit("noise"))
    found = nearest_centroid(df, centers, cols, key, own=cluster)
    found = found.withColumn("_near", F.coalesce("_nearest", cluster)).drop("_nearest", "_nearest_distance", "_second", "_second_distance")
    if label is None:
        return found.withColumn("_nearest_major_class", cluster_name(F.col("_near"))).drop("_near")
    classes = small(majority_class(df, label, cluster).select(F.col("cluster").alias("_near"), F.col("majority").alias("_nearest_major_class")))
    return found.join(classes, "_near", "left").drop("_near")


def review_priority(outlier: Column, island: Column, confidence: Column | None = None) -> Column:
    """90 noise, 70 island, 30 other, plus up to 20 for low confidence, at most 100."""
    base = F.when(outlier, F.lit(90)).when(island, F.lit(70)).otherwise(F.lit(30))
    if confidence is None:
        return base
    doubt = F.greatest(F.lit(0), ((F.lit(1.0) - confidence) * F.lit(20.0)).cast("int"))
    return F.when(confidence.isNull() | F.isnan(confidence), base).otherwise(F.least(F.lit(100), base + doubt))


def feature_differences(df: DataFrame, cols: Sequence[str], cluster: str = "_cluster", top: int = 3) -> DataFrame:
    """(cluster, feature, cluster_mean, global_mean, rank, size) of the largest mean shifts of island clusters."""
    sizes = cluster_sizes(df, cluster)
    n = sizes.agg(F.coalesce(F.sum("_cluster_size"), F.lit(0))).first()[0]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    islands = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)]).filter(
        (F.col("cluster") != -1) & (F.col("size") <= small_cluster_size(n))
    )
    shifts = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"a{i}").alias("cluster_mean"), F.lit(means[f"m{i}"]).cast("double").alias("global_mean"))
        for i, c in enumerate(cols)
    ])
    long = islands.select("cluster", "size", F.inline(shifts))
    order = W.partitionBy("cluster").orderBy(F.abs(F.col("cluster_mean") - F.col("global_mean")).desc(), F.col("pos").asc())
    return long.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).drop("pos")


def island_decisions(df: DataFrame, cols: Sequence[str], cluster: str = "_cluster") -> DataFrame:
    """Per island cluster: decision, reason (naming the two largest shifts) and action."""
    top = feature_differences(df, cols, cluster, 2)
    names = top.groupBy("cluster", "size").agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("f"))
    tiny = F.col("size") <= 3
    listed = F.array_join(F.transform("f", lambda s: s["feature"]), ", ")
    return names.select(
        "cluster", "size", F.when(tiny, F.lit(LIKELY_OUTLIER)).otherwise(F.lit(MERGE)).alias("decision"),
        F.when(tiny, F.lit(REASON_SMALL)).otherwise(F.concat(F.lit(REASON_DIFFERS), listed, F.lit("."))).alias("reason"),
        F.lit(MANUAL).alias("recommended_action"),
    )


def decision_columns(df: DataFrame, cols: Sequence[str], cluster: str = "_cluster") -> DataFrame:
    """_nano_decision, _nano_reason, _nano_recommended_action; empty outside island clusters."""
    names = {"decision": "_nano_decision", "reason": "_nano_reason", "recommended_action": "_nano_recommended_action"}
    made = small(island_decisions(df, cols, cluster).select(F.col("cluster").alias(cluster), *[F.col(a).alias(b) for a, b in names.items()]))
    return df.join(made, cluster, "left").withColumns({b: F.coalesce(b, F.lit("")) for b in names.values()})
