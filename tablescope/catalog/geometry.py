"""Distance joins, clustering and derived cluster columns."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.operators import anomaly as A
from tablescope.operators import cluster as C
from tablescope.operators import metrics as M
from tablescope.operators import neighbors as N

AXES = ["x", "y"]


def _customers(s, d):
    """Customers on a plane: balance against nation, both near 0..10."""
    return read(s, d, "customer").select(
        (F.col("c_custkey") + 1).alias("_row_id"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 2.5 + F.col("c_custkey") % 7 / 20).alias("y"),
        F.col("c_mktsegment").alias("seg"),
    )


_CUSTOMERS = """(SELECT c_custkey + 1 AS _row_id, c_acctbal / 1000 AS x, c_nationkey / 2.5::DOUBLE + c_custkey % 7 / 20::DOUBLE AS y, c_mktsegment AS seg FROM customer)"""
_SUPPLIERS = """(SELECT s_suppkey + 1 AS _row_id, s_acctbal / 1000 AS x, s_nationkey / 2.5::DOUBLE AS y FROM supplier)"""


def _suppliers(s, d):
    return read(s, d, "supplier").select((F.col("s_suppkey") + 1).alias("_row_id"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 2.5).alias("y"))


def _near(source, eps, cols=("x", "y")):
    gap = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in cols)
    return f"near AS (SELECT a._row_id AS a, b._row_id AS b FROM {source} a JOIN {source} b ON sqrt({gap}) <= {eps})"


def _dbscan_sql(source, eps, m, cols=("x", "y")):
    """Reachability between core rows by recursion; numbers by first core row; borders take the smallest."""
    return f"""
        WITH RECURSIVE {_near(source, eps, cols)},
        core AS (SELECT a AS k FROM near GROUP BY 1 HAVING count(*) >= {m}),
        links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
        reach AS (SELECT k AS start, k FROM core UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.k),
        comp AS (SELECT k, min(start) AS first FROM reach GROUP BY 1),
        num AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS c FROM (SELECT DISTINCT first FROM comp)),
        lab AS (SELECT k, c FROM comp JOIN num USING (first)),
        border AS (SELECT near.a AS k, min(c) AS c FROM near JOIN lab ON lab.k = near.b WHERE near.a NOT IN (FROM core) GROUP BY 1)
        SELECT _row_id, coalesce(lab.c, border.c, -1)::INT AS _cluster FROM {source} s LEFT JOIN lab ON lab.k = _row_id LEFT JOIN border ON border.k = _row_id"""


def _dbscan(s, d):
    return C.dbscan(_suppliers(s, d), AXES, "_row_id", 0.6, 3).select("_row_id", "_cluster")


def _dbscan_customers(s, d):
    return C.dbscan(_customers(s, d), AXES, "_row_id", 0.25, 10).select("_row_id", "_cluster")


def _embedding_axes(s, d):
    from tablescope.plans.workflows import project

    vectors = read(s, d, "embeddings").select(
        (F.col("vec_id") + 1).alias("_row_id"), "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    return project(vectors, 3)


def _dbscan_embeddings(s, d):
    """Rows only: the axes come from a fitted projection."""
    rows, _, _, _ = _embedding_axes(s, d)
    return C.dbscan(rows.select("_row_id", "_p0", "_p1", "_p2"), ["_p0", "_p1", "_p2"], "_row_id", 0.1, 5).select("_row_id", "_cluster")


def _pca(s, d):
    """Invariants of the projection: centred axes, shares in order."""
    rows, _, _, shares = _embedding_axes(s, d)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.avg("_p0")) < 1e-9).alias("centred"), (F.var_pop("_p0") >= F.var_pop("_p1")).alias("ordered"),
        F.lit(0 < sum(shares) <= 1).alias("shares_ok"),
    )


def _knn(s, d):
    return N.knn_join(_customers(s, d), AXES, 5, "_row_id").withColumn("distance", F.round("distance", 8))


_KNN_SQL = f"""
    WITH p AS (SELECT *, min(_row_id) OVER (PARTITION BY x, y) AS spot FROM {_CUSTOMERS}),
    n AS (SELECT a._row_id, b._row_id AS neighbor, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, b.spot FROM p a JOIN p b ON a._row_id <> b._row_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY _row_id ORDER BY distance, spot, neighbor) AS rank FROM n)
    SELECT _row_id, neighbor, round(distance, 8) AS distance, rank FROM r WHERE rank <= 5"""


def _lof(s, d):
    out = N.local_outlier_factor(_customers(s, d), AXES, 10, "_row_id", "lof")
    return out.select("_row_id", F.round("lof", 6).alias("lof"))


_LOF_SQL = f"""
    WITH p AS (SELECT *, min(_row_id) OVER (PARTITION BY x, y) AS spot FROM {_CUSTOMERS}),
    n AS (SELECT a._row_id AS a, b._row_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, b.spot FROM p a JOIN p b ON a._row_id <> b._row_id),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, spot, b) AS k FROM n) WHERE k <= 10),
    kd AS (SELECT a, max(dist) AS kd FROM r GROUP BY 1),
    lrd AS (SELECT r.a, 1 / (avg(greatest(kd.kd, dist)) + 1e-10) AS lrd FROM r JOIN kd ON kd.a = r.b GROUP BY 1)
    SELECT r.a AS _row_id, round(avg(o.lrd) / any_value(m.lrd), 6) AS lof FROM r JOIN lrd o ON o.a = r.b JOIN lrd m ON m.a = r.a GROUP BY 1"""


# Groups of 30 customers in six columns, far from each other.
_GROUPED = [f"(floor(c_custkey / 30) * {7919 + 131 * i} % 10007 + c_custkey * {31 + 17 * i} % 13 / 20.0::DOUBLE) AS c{i}" for i in range(6)]
_GROUPED_SQL = f"(SELECT c_custkey + 1 AS _row_id, {', '.join(_GROUPED)} FROM customer)"


def _grouped(s, d):
    k = F.col("c_custkey")
    return read(s, d, "customer").select((k + 1).alias("_row_id"), *[
        (F.floor(k / 30) * (7919 + 131 * i) % 10007 + k * (31 + 17 * i) % 13 / 20).alias(f"c{i}") for i in range(6)])


def _dbscan_grouped(s, d):
    return C.dbscan(_grouped(s, d), [f"c{i}" for i in range(6)], "_row_id", 0.7001, 4).select("_row_id", "_cluster")


def _gap(cols):
    return "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in cols) + ")"


def _flags(s, d):
    """Two 0/1 columns and a balance: many copies, regions that no cut can balance."""
    k = F.col("c_custkey")
    return read(s, d, "customer").select(
        (k + 1).alias("_row_id"), (k % 2).cast("double").alias("f1"), (k % 7 == 0).cast("double").alias("f2"), F.floor(F.col("c_acctbal") / 500).cast("double").alias("v"))


_FLAGS = "(SELECT c_custkey + 1 AS _row_id, (c_custkey % 2)::DOUBLE AS f1, (c_custkey % 7 = 0)::INT::DOUBLE AS f2, floor(c_acctbal / 500)::DOUBLE AS v FROM customer)"
_FLAG_AXES = ["f1", "f2", "v"]
_FLAG_NEAR = f"""p AS (SELECT *, min(_row_id) OVER (PARTITION BY f1, f2, v) AS spot FROM {_FLAGS}),
    n AS (SELECT a._row_id AS a, b._row_id AS b, {_gap(_FLAG_AXES)} AS dist, b.spot FROM p a JOIN p b ON a._row_id <> b._row_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, spot, b) AS k FROM n)"""


def _knn_flags(s, d):
    return N.knn_join(_flags(s, d), _FLAG_AXES, 7, "_row_id").withColumn("distance", F.round("distance", 8))


def _lof_flags(s, d):
    out = N.local_outlier_factor(_flags(s, d), _FLAG_AXES, 40, "_row_id", "lof")
    return out.select("_row_id", (F.round(F.log("lof"), 5) + 0.0).alias("log_lof"))


_LOF_FLAGS_SQL = f"""
    WITH {_FLAG_NEAR}, t AS (SELECT * FROM r WHERE k <= 40),
    kd AS (SELECT a, max(dist) AS kd FROM t GROUP BY 1),
    lrd AS (SELECT t.a, 1 / (avg(greatest(kd.kd, dist)) + 1e-10) AS lrd FROM t JOIN kd ON kd.a = t.b GROUP BY 1)
    SELECT t.a AS _row_id, round(ln(avg(o.lrd) / any_value(m.lrd)), 5) + 0 AS log_lof FROM t JOIN lrd o ON o.a = t.b JOIN lrd m ON m.a = t.a GROUP BY 1"""


_CROWDED = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 11 / 100.0::DOUBLE ELSE c_acctbal END AS x, c_custkey % 7 / 100.0::DOUBLE AS y, c_custkey % 5 / 100.0::DOUBLE AS z, c_custkey % 3 / 100.0::DOUBLE AS w FROM customer)"


def _crowded(s, d):
    """Half of the customers within a hand's breadth, in four columns."""
    k = F.col("c_custkey")
    return read(s, d, "customer").select(
        k.alias("k"), F.when(k % 2 == 0, k % 11 / 100).otherwise(F.col("c_acctbal")).alias("x"), (k % 7 / 100).alias("y"), (k % 5 / 100).alias("z"), (k % 3 / 100).alias("w"))


def _core(s, d):
    return C.core_points(_customers(s, d), AXES, "_row_id", 0.4, 8)


_CORE_SQL = f"WITH {_near(_CUSTOMERS, 0.4)} SELECT a AS _row_id, count(*) >= 8 AS is_core FROM near GROUP BY 1"


def _labelled(s, d):
    """Given clusters: by segment and balance, a small one and noise."""
    k = F.col("_row_id")
    return _customers(s, d).withColumn("_cluster", F.when(k % 50 == 0, F.lit(-1)).when(k % 200 == 7, F.lit(5)).when(k % 300 == 11, F.lit(6)).otherwise((k % 4).cast("int")))


_LABELLED = f"""(SELECT *, CASE WHEN _row_id % 50 = 0 THEN -1 WHEN _row_id % 200 = 7 THEN 5 WHEN _row_id % 300 = 11 THEN 6 ELSE (_row_id % 4)::INT END AS _cluster FROM {_CUSTOMERS})"""
_CENTERS = f"(SELECT _cluster AS c, avg(x) AS cx, avg(y) AS cy, count(*) AS k FROM {_LABELLED} WHERE _cluster <> -1 GROUP BY 1)"
_LIMIT = f"greatest(3, (SELECT count(*) FROM {_LABELLED}) // 20)"


def _centroids(s, d):
    out = N.centroids(_labelled(s, d).filter("_cluster <> -1"), AXES, "_cluster")
    return out.select("cluster", "size", F.round(F.col("center")[0], 8).alias("cx"), F.round(F.col("center")[1], 8).alias("cy"))


def _nearest(s, d, own):
    df = _labelled(s, d)
    out = N.nearest_centroid(df, N.centroids(df.filter("_cluster <> -1"), AXES, "_cluster"), AXES, "_row_id", own)
    return out.select("_row_id", "_nearest", "_second", F.round("_nearest_distance", 6).alias("d1"), F.round("_second_distance", 6).alias("d2"))


def _nearest_sql(own):
    skip = "WHERE c <> _cluster" if own else ""
    return f"""
        WITH r AS (SELECT _row_id, c, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM {_LABELLED} l CROSS JOIN {_CENTERS} m {skip}),
        o AS (SELECT *, row_number() OVER (PARTITION BY _row_id ORDER BY d, c) AS k FROM r)
        SELECT _row_id, max(c) FILTER (k = 1) AS _nearest, max(c) FILTER (k = 2) AS _second, round(max(d) FILTER (k = 1), 6) AS d1, round(max(d) FILTER (k = 2), 6) AS d2 FROM o GROUP BY 1"""


def _cluster_columns(s, d):
    df = C.cluster_columns(C.distance_to_centroid(_labelled(s, d), AXES))
    return df.select("_row_id", "_cluster_id", "_cluster_size", "_is_noise", "_is_small_cluster", F.round("_distance_to_centroid", 6).alias("_distance_to_centroid"))


_CLUSTER_COLUMNS_SQL = f"""
    WITH l AS (SELECT *, count(*) OVER (PARTITION BY _cluster) AS n FROM {_LABELLED}),
    d AS (SELECT _row_id, min(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS d FROM l CROSS JOIN {_CENTERS} m WHERE _cluster = -1 OR c = _cluster GROUP BY 1)
    SELECT _row_id, CASE WHEN _cluster = -1 THEN 'noise' ELSE 'cluster_' || _cluster END AS _cluster_id, n AS _cluster_size, _cluster = -1 AS _is_noise,
           n <= {_LIMIT} OR _cluster = -1 AS _is_small_cluster, round(d, 6) AS _distance_to_centroid FROM l JOIN d USING (_row_id)"""


def _cluster_metrics(s, d):
    return C.cluster_metrics(_labelled(s, d)).withColumn("value", F.round("value", 6))


_CLUSTER_METRICS_SQL = f"""
    SELECT 'cluster_count' AS metric, count(DISTINCT _cluster) FILTER (_cluster <> -1)::DOUBLE AS value FROM {_LABELLED}
    UNION ALL SELECT 'noise_count', count(*) FILTER (_cluster = -1)::DOUBLE FROM {_LABELLED}
    UNION ALL SELECT 'noise_ratio', round(count(*) FILTER (_cluster = -1) / count(*), 6) FROM {_LABELLED}
    UNION ALL SELECT 'small_cluster_count', count(*)::DOUBLE FROM {_CENTERS} WHERE k <= {_LIMIT}"""


def _silhouette(s, d):
    """A cluster of one row scores 0."""
    return M.silhouette_squared(_labelled(s, d), AXES, "_cluster").select(F.round("silhouette_squared", 6).alias("silhouette_squared"))


_SILHOUETTE_SQL = f"""
    WITH m AS (SELECT _cluster AS c, count(*) AS k, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS q FROM {_LABELLED} GROUP BY 1),
    g AS (SELECT _row_id, _cluster, c, k, x * x + y * y - 2 * (x * mx + y * my) + q AS d FROM {_LABELLED} CROSS JOIN m),
    s AS (SELECT _row_id, max(CASE WHEN c = _cluster AND k > 1 THEN d * k / (k - 1) END) AS a, min(CASE WHEN c <> _cluster THEN d END) AS b FROM g GROUP BY 1)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette_squared FROM s"""


def _major(s, d, label):
    return C.nearest_major_class(_labelled(s, d), AXES, label=label).select("_row_id", "_nearest_major_class")


_MAJORITY = f"(SELECT _cluster AS c, arg_min(seg, (-n, seg)) AS major FROM (SELECT _cluster, seg, count(*) AS n FROM {_LABELLED} WHERE _cluster <> -1 GROUP BY 1, 2) GROUP BY 1)"
_MAJOR_SQL = f"SELECT _row_id, major AS _nearest_major_class FROM ({_nearest_sql(True)}) n JOIN {_MAJORITY} m ON m.c = n._nearest"
_MAJOR_NAME_SQL = f"SELECT _row_id, 'cluster_' || _nearest AS _nearest_major_class FROM ({_nearest_sql(True)})"


def _review(s, d):
    flagged = C.island_columns(_labelled(s, d))
    confidence = F.when(F.col("_row_id") % 9 != 0, F.col("_row_id") % 100 / 100.0)
    return flagged.select("_row_id", "_cluster_id", "_is_island", "_is_outlier", C.review_priority(F.col("_is_outlier"), F.col("_is_island"), confidence).alias("_review_priority"))


_REVIEW_SQL = f"""
    WITH l AS (SELECT *, count(*) OVER (PARTITION BY _cluster) AS n FROM {_LABELLED}),
    f AS (SELECT *, n <= {_LIMIT} OR _cluster = -1 AS island, CASE WHEN _row_id % 9 <> 0 THEN trunc((1 - _row_id % 100 / 100.0::DOUBLE) * 20.0::DOUBLE)::INT ELSE 0 END AS extra FROM l)
    SELECT _row_id, CASE WHEN _cluster = -1 THEN 'noise' ELSE 'cluster_' || _cluster END AS _cluster_id, island AS _is_island, _cluster = -1 AS _is_outlier,
           least(100, CASE WHEN _cluster = -1 THEN 90 WHEN island THEN 70 ELSE 30 END + extra) AS _review_priority FROM f"""


def _diffs(s, d):
    df = _labelled(s, d).withColumns({"z": F.col("_row_id") % 11 * 1.0, "w": F.col("x") - F.col("y")})
    out = C.feature_differences(df, ["x", "y", "z", "w"])
    return out.withColumns({"cluster_mean": F.round("cluster_mean", 6), "global_mean": F.round("global_mean", 6)})


_DIFF_BASE = f"""
    v AS (SELECT _cluster, x, y, (_row_id % 11)::DOUBLE AS z, x - y AS w FROM {_LABELLED}),
    a AS (UNPIVOT (SELECT _cluster, count(*) AS size, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(w) AS w FROM v GROUP BY 1) ON x, y, z, w INTO NAME feature VALUE cluster_mean),
    g AS (UNPIVOT (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(w) AS w FROM v) ON x, y, z, w INTO NAME feature VALUE global_mean),
    r AS (SELECT *, row_number() OVER (PARTITION BY _cluster ORDER BY abs(cluster_mean - global_mean) DESC, feature) AS rank FROM a JOIN g USING (feature) WHERE _cluster <> -1 AND size <= {_LIMIT})"""
_DIFF_SQL = f"WITH {_DIFF_BASE} SELECT _cluster AS cluster, size, feature, round(cluster_mean, 6) AS cluster_mean, round(global_mean, 6) AS global_mean, rank FROM r WHERE rank <= 3"


def _decisions(s, d):
    df = _labelled(s, d).withColumns({"z": F.col("_row_id") % 11 * 1.0, "w": F.col("x") - F.col("y")})
    return C.decision_columns(df, ["x", "y", "z", "w"]).select("_row_id", "_nano_decision", "_nano_reason", "_nano_recommended_action")


_DECISION_SQL = f"""
    WITH {_DIFF_BASE},
    t AS (SELECT _cluster, size, string_agg(feature, ', ' ORDER BY rank) AS names FROM r WHERE rank <= 2 GROUP BY 1, 2)
    SELECT _row_id, CASE WHEN t.size IS NULL THEN '' WHEN t.size <= 3 THEN 'likely_outlier' ELSE 'merge_with_nearest_cluster' END AS _nano_decision,
           CASE WHEN t.size IS NULL THEN '' WHEN t.size <= 3 THEN 'Small isolated cluster may be unstable for learning.' ELSE 'Cluster differs mainly on ' || names || '.' END AS _nano_reason,
           CASE WHEN t.size IS NULL THEN '' ELSE 'review_manually' END AS _nano_recommended_action FROM {_LABELLED} LEFT JOIN t USING (_cluster)"""


def _kmeans(s, d):
    out = C.kmeans(_customers(s, d), AXES)
    return out.groupBy("_cluster").agg(F.count(F.lit(1)).alias("n"), (F.max("_distance_to_centroid") < 20).alias("close"))


def _isolation(s, d):
    """Anomalous line items: the share above the cut is the asked one up to ties."""
    df = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    scored = A.isolation_scores(df, ["l_extendedprice", "l_quantity", "l_discount"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("_raw_score") > 0) & (F.col("_raw_score") < 1)).alias("in_range"),
        (F.corr("_raw_score", F.abs(F.col("l_extendedprice") - 50000)) > 0).alias("far_is_stranger"),
    )


def _kernel(s, d):
    scored = A.kernel_scores(_customers(s, d), AXES)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_raw_score").isNull()).alias("missing"))


QUERIES = {
    "eps_join": (
        lambda s, d: N.eps_join(read(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 4).alias("y")), ["x", "y"], 0.6, "s_suppkey").select(
            "left", "right", F.round("distance", 6).alias("distance")),
        """WITH p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey / 4.0::DOUBLE AS y FROM supplier)
           SELECT a.k AS "left", b.k AS "right", round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.k < b.k
           WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.6""",
    ),
    "eps_join_crowded": (
        lambda s, d: N.eps_join(_crowded(s, d), ["x", "y", "z", "w"], 0.21, "k").groupBy(F.col("left").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 5).alias("total")),
        f"""WITH p AS {_CROWDED} SELECT a.k, count(*) AS n, round(sum({_gap(["x", "y", "z", "w"])}), 5) AS total FROM p a JOIN p b ON a.k < b.k WHERE {_gap(["x", "y", "z", "w"])} <= 0.21 GROUP BY 1""",
    ),
    "eps_core": (_core, _CORE_SQL),
    "dbscan": (_dbscan, _dbscan_sql(_SUPPLIERS, 0.6, 3)),
    "dbscan_customers": (_dbscan_customers, _dbscan_sql(_CUSTOMERS, 0.25, 10)),
    "dbscan_six_columns": (_dbscan_grouped, _dbscan_sql(_GROUPED_SQL, 0.7001, 4, tuple(f"c{i}" for i in range(6)))),
    "knn_flags": (_knn_flags, f"WITH {_FLAG_NEAR} SELECT a AS _row_id, b AS neighbor, round(dist, 8) AS distance, k AS rank FROM r WHERE k <= 7"),
    "lof_flags": (_lof_flags, _LOF_FLAGS_SQL),
    "dbscan_embeddings": (_dbscan_embeddings, None),
    "pca_projection": (_pca, None),
    "knn_exact": (_knn, _KNN_SQL),
    "lof": (_lof, _LOF_SQL),
    "centroids": (_centroids, f"SELECT c AS cluster, k AS size, round(cx, 8) AS cx, round(cy, 8) AS cy FROM {_CENTERS}"),
    "nearest_centroid": (lambda s, d: _nearest(s, d, None), _nearest_sql(False)),
    "nearest_other_centroid": (lambda s, d: _nearest(s, d, "_cluster"), _nearest_sql(True)),
    "cluster_columns": (_cluster_columns, _CLUSTER_COLUMNS_SQL),
    "cluster_metrics": (_cluster_metrics, _CLUSTER_METRICS_SQL),
    "cluster_majority_class": (lambda s, d: C.majority_class(_labelled(s, d), "seg"), f"SELECT c AS cluster, major AS majority FROM {_MAJORITY}"),
    "silhouette_squared": (_silhouette, _SILHOUETTE_SQL),
    "nearest_major_class": (lambda s, d: _major(s, d, "seg"), _MAJOR_SQL),
    "nearest_major_name": (lambda s, d: _major(s, d, None), _MAJOR_NAME_SQL),
    "review_priority": (_review, _REVIEW_SQL),
    "feature_differences": (_diffs, _DIFF_SQL),
    "island_decisions": (_decisions, _DECISION_SQL),
    "kmeans": (_kmeans, None),
    "isolation_forest": (_isolation, None),
    "kernel_density": (_kernel, None),
}
