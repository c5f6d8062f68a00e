"""Model fits and boundary data."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.catalog.features import KEY
from tablescope.operators import boundary as B
from tablescope.operators import models as K
from tablescope.operators import rows as R

from tablescope.plans import surface as S
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles

C, L = F.col, F.lit
FEATURES = ("l_quantity", "l_discount", "l_tax", "l_returnflag")


def _lines(s, d):
    """Line items with a learnable class and a learnable number."""
    return read(s, d, "lineitem").select(
        *KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag",
        F.when(C("l_quantity") * (1 - C("l_discount")) > 25, L("hi")).otherwise(L("lo")).alias("size"), (3 * C("l_quantity") + 10 * C("l_tax")).alias("cost"),
    )


def _values(metrics, **checks):
    """The asked metrics as yes/no against a limit, so that results are stable."""
    picks = [(F.max(F.when(C("metric") == m, C("value"))) > limit).alias(f"{m}_ok") for m, limit in checks.items()]
    return metrics.agg(*picks)


def _classify(s, d, algorithm, **params):
    out = W.fit_supervised(_lines(s, d), Roles(FEATURES, "size"), PrepSpec(), algorithm, "classification", KEY, **params)
    return _values(out.metrics, test_accuracy=0.8, test_f1=0.8, train_f1=0.8, confidence_mean=0.5)


def _regress(s, d, algorithm, **params):
    out = W.fit_supervised(_lines(s, d), Roles(FEATURES, "cost"), PrepSpec(), algorithm, "regression", KEY, **params)
    return _values(out.metrics, test_r2=0.7, train_r2=0.7)


def _multiclass(s, d, algorithm, **params):
    """Embedding labels: ten classes in all dimensions."""
    vectors = read(s, d, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    df = vectors.select("vec_id", C("label").cast("string").alias("label"), *[F.get("embedding", L(i)).cast("double").alias(f"e{i}") for i in range(size)])
    out = W.fit_supervised(df, Roles(tuple(f"e{i}" for i in range(size)), "label"), PrepSpec(), algorithm, "classification", ["vec_id"], **params)
    return out.rows.groupBy("_split_role").agg(
        F.count(L(1)).alias("n"), F.bool_and(C("_prediction_confidence").between(0, 1)).alias("confidence_ok"), F.bool_or(~C("_is_correct")).alias("some_wrong"),
    )


def _ols(s, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(read(s, d, "lineitem").select("l_quantity", C("l_extendedprice").alias("_y")))
    est = K.build_estimator("linear_regression", False, 1)
    model = est.fit(df) if isinstance(est, LinearRegression) else None
    stats = df.agg(F.count(L(1)).alias("n"))
    return stats.select("n", F.round(L(float(model.coefficients[0])), 3).alias("slope"), F.round(L(float(model.intercept)), 3).alias("intercept"))


def _class_weights(s, d):
    out = K.class_weights(read(s, d, "orders"), "o_orderpriority", "balanced")
    return out.groupBy("o_orderpriority").agg(F.round(F.max("_weight"), 9).alias("weight"), F.count(L(1)).alias("n"))


def _importance(s, d):
    out = W.fit_supervised(_lines(s, d), Roles(FEATURES, "size"), PrepSpec(), "random_forest", "classification", KEY)
    score = K.feature_importance(out.model, out.rows, out.model.pre.positions(), ["_row_id"])
    low = R.low_importance(score, 0.2, ["size"]).select("feature", L(True).alias("is_low"))
    return score.join(low, "feature", "left").select("feature", F.coalesce("is_low", L(False)).alias("is_low"), (C("score") >= 0).alias("ok"))


def _permutation(s, d):
    df = _lines(s, d)
    roles = Roles(("l_quantity", "l_discount", "l_tax"), "size")
    ready, pre, _ = W.split_and_fit_preprocessor(df, roles, PrepSpec(), "classification", KEY, {})
    model = K.fit_vectors(ready.filter("_split_role = 'train'"), pre, "size", "logistic_regression", "classification")
    score = K.feature_importance(model, ready, pre.positions(), ["_row_id"])
    return score.select("feature", (C("score") > 0.1).alias("matters"))


def _predict(s, d):
    """Fit on all lines (the fit makes its own split), score all lines."""
    df = _lines(s, d)
    model = W.fit_supervised(df, Roles(FEATURES, "size"), PrepSpec(), "logistic_regression", "classification", KEY).model
    scored = K.predict(model, df)
    return scored.groupBy("size").agg(F.count(L(1)).alias("n"), (F.avg((C("size") == C("_predicted_class")).cast("int")) > 0.8).alias("mostly_right"))


def _prepare(s, d):
    out = W.prepare(_lines(s, d), Roles(FEATURES, "size"), PrepSpec(), "random_forest", KEY)
    return out.rows.agg(
        F.count(L(1)).alias("n"), F.bool_and(C("norm_l_quantity").between(0, 1)).alias("scaled"), F.bool_and(C("_review_priority").between(30, 100)).alias("priority_ok"),
        F.bool_and(C("_nearest_major_class").isin("hi", "lo")).alias("class_ok"),
    )


def _surface_source(s, d):
    """Customers with a learnable class, on few columns."""
    return read(s, d, "customer").select(
        "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", F.when(C("c_acctbal") / 400 > C("c_nationkey"), L("rich")).otherwise(L("poor")).alias("class")
    )


def _snapshot(s, d):
    return S.boundary_snapshot(_surface_source(s, d), Roles(("c_acctbal", "c_nationkey"), "class"), PrepSpec(), "random_forest", order_by=["c_custkey"])


def _snapshot_points(s, d):
    return _snapshot(s, d).points.agg(
        F.count(L(1)).alias("n"), (F.avg(C("is_misclassified").cast("int")) < 0.3).alias("mostly_right"), F.bool_and(C("confidence").between(0, 1)).alias("confidence_ok")
    )


def _snapshot_grid(s, d):
    return _snapshot(s, d).grid.agg(F.count(L(1)).alias("n"), F.count_distinct("predicted_label").alias("labels"), F.bool_and(C("confidence").between(0, 1)).alias("ok"))


# Given coordinates and a stored result: everything after projection and fit has a SQL twin.
def _given(s, d):
    k = C("c_custkey")
    return read(s, d, "customer").select(
        (k + 1).alias("_row_id"), (C("c_acctbal") / 1000).alias("_p0"), (C("c_nationkey") / 10.0).alias("_p1"), C("c_mktsegment").alias("seg"),
        F.when(k % 3 == 0, L("BUILDING")).otherwise(C("c_mktsegment")).alias("_predicted_class"), (k % 100 / 100.0).alias("_prediction_confidence"),
    )


def _stored(s, d):
    k = C("c_custkey")
    return read(s, d, "customer").filter(k % 4 != 0).select(
        (k + 1).alias("_row_id"), F.when(k % 5 == 0, L("MACHINERY")).alias("_predicted_class"), F.when(k % 7 != 0, (k % 10) / 10.0).alias("_prediction_confidence"),
        (k % 6 == 0).alias("_is_outlier"), (k % 8 == 1).alias("_is_island"), (k % 90).cast("int").alias("_review_priority"),
        F.when(k % 9 == 0, L("")).otherwise(F.concat(L("cluster_"), (k % 3).cast("string"))).alias("_cluster_id"),
        F.when(k % 10 != 0, (k % 13) / 10.0).alias("_distance_to_centroid"), (k % 11 == 0).alias("_is_noise"), (k % 12 == 0).alias("_is_small_cluster"),
    )


_GIVEN = """(SELECT c_custkey AS k, c_custkey + 1 AS _row_id, c_acctbal / 1000 AS x, c_nationkey / 10.0::DOUBLE AS y, c_mktsegment AS seg, c_custkey % 4 <> 0 AS st FROM customer)"""
_POINTS_SQL = f"""
    SELECT _row_id, x, y, seg AS true_label, p AS predicted_label, conf AS confidence, seg <> p AS is_misclassified, st AND k % 6 = 0 AS is_outlier, st AND k % 8 = 1 AS is_island,
           CASE WHEN st THEN k % 90 ELSE 0 END::INT AS review_priority, CASE WHEN st AND k % 9 <> 0 THEN 'cluster_' || k % 3 END AS cluster_id
    FROM (SELECT *, CASE WHEN st AND k % 5 = 0 THEN 'MACHINERY' WHEN k % 3 = 0 THEN 'BUILDING' ELSE seg END AS p,
                 CASE WHEN st AND k % 7 <> 0 THEN k % 10 / 10.0::DOUBLE ELSE k % 100 / 100.0::DOUBLE END AS conf FROM {_GIVEN})"""
_CLUSTER_POINTS_SQL = f"""
    SELECT _row_id, x, y, c AS true_label, c AS predicted_label,
           CASE WHEN st AND k % 10 <> 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - k % 13 / 10.0::DOUBLE)) WHEN c = 'noise' THEN 0.2 ELSE 0.7 END AS confidence, false AS is_misclassified,
           (st AND k % 11 = 0) OR c = 'noise' AS is_outlier, st AND k % 12 = 0 AS is_island, CASE WHEN st THEN k % 90 ELSE 0 END::INT AS review_priority, c AS cluster_id
    FROM (SELECT *, CASE WHEN st AND k % 9 <> 0 THEN 'cluster_' || k % 3 ELSE 'noise' END AS c FROM {_GIVEN})"""
_MESH = """
    r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), m AS (SELECT *, greatest(x1 - x0, 1e-6) * 0.18::DOUBLE AS mx, greatest(y1 - y0, 1e-6) * 0.18::DOUBLE AS my FROM r),
    g AS (SELECT i AS cell, (x0 - mx) + (i % 40) * ((x1 + mx - (x0 - mx)) / 39) AS x, (y0 - my) + (i // 40) * ((y1 + my - (y0 - my)) / 39) AS y FROM m, range(1600) t(i))"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _points(s, d):
    return B.boundary_points(_given(s, d), "seg", _stored(s, d))


def _cluster_points(s, d):
    return B.cluster_points(_given(s, d), _stored(s, d))


def _mesh(s, d):
    return _rounded(B.surface_mesh(s, B.axes(_given(s, d), "_p0", "_p1")), "x", "y")


def _cluster_grid(s, d):
    points = _cluster_points(s, d)
    return _rounded(B.cluster_grid(points, B.axes(points, "x", "y")), "x", "y", "confidence")


_GRID_SQL = f"""
    WITH p AS ({_CLUSTER_POINTS_SQL}), {_MESH}, c AS (SELECT cluster_id AS c, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1),
    n AS (SELECT cell, x, y, c, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM g CROSS JOIN c),
    o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d, c) AS k FROM n)
    SELECT round(x, 6) AS x, round(y, 6) AS y, max(c) FILTER (k = 1) AS predicted_label,
           round(greatest(0.0, least(1.0, 1 - max(d) FILTER (k = 1) / greatest(max(d) FILTER (k = 2), 1e-6))), 6) AS confidence FROM o GROUP BY cell, x, y"""


def _stats(s, d, kind):
    points = _points(s, d) if kind == "classification" else _cluster_points(s, d)
    return B.boundary_stats(points, B.axes(points, "x", "y"), 2, 2, (), kind)


def _stats_sql(points, low, more=""):
    return f"""WITH p AS ({points})
        SELECT 'point_count' AS statistic, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'misclassified_count', count(*) FILTER (is_misclassified) FROM p
        UNION ALL SELECT 'low_confidence_count', count(*) FILTER (confidence < {low}) FROM p UNION ALL SELECT 'outlier_count', count(*) FILTER (is_outlier) FROM p
        UNION ALL SELECT 'island_count', count(*) FILTER (is_island) FROM p UNION ALL SELECT 'feature_count', 2 UNION ALL SELECT 'numeric_feature_count', 2
        UNION ALL SELECT 'grid_point_count', 1600 {more}"""


_CLUSTER_STATS = "UNION ALL SELECT 'cluster_count', count(DISTINCT cluster_id) FILTER (cluster_id <> 'noise') FROM p UNION ALL SELECT 'noise_count', count(*) FILTER (is_outlier) FROM p"


def _prepare_stats(s, d):
    """Counts of all customers with given flags."""
    k = C("c_custkey")
    flagged = read(s, d, "customer").select(
        (k % 8 == 1).alias("_is_island"), (k % 6 == 0).alias("_is_outlier"), F.concat(L("cluster_"), (k % 31).cast("string")).alias("_cluster_id"),
        F.when(k % 8 == 1, L("review")).otherwise(L("")).alias("_nano_decision"))
    return W.prepare_stats(flagged, 4)


_PREPARE_STATS_SQL = """
    SELECT count(*) AS row_count, 4::BIGINT AS feature_count, count(*) FILTER (c_custkey % 8 = 1) AS island_count, count(*) FILTER (c_custkey % 6 = 0) AS outlier_count,
           count(DISTINCT c_custkey % 31) FILTER (c_custkey % 8 = 1) AS nano_explanations FROM customer"""


def _anomaly_flow(s, d, algorithm):
    df = read(s, d, "supplier" if algorithm == "local_outlier_factor" else "customer")
    key = df.columns[0]
    bal = "s_acctbal" if key == "s_suppkey" else "c_acctbal"
    from tablescope.plans.workflows import detect_anomalies

    out = detect_anomalies(df, Roles((bal,), id=key), algorithm=algorithm, order_by=[key])
    return out.rows.agg(F.count(L(1)).alias("n"), (F.max("_anomaly_rank") == F.count(L(1))).alias("ranked"), (F.avg(C("_is_anomaly").cast("int")) <= 0.1).alias("share_ok"))


def _noise_flow(s, d):
    out = W.reduce_noise(read(s, d, "customer"), Roles(("c_acctbal",), id="c_custkey"), order_by=["c_custkey"])
    return out.rows.groupBy("_noise_reason", "_proposed_action").agg(F.count(L(1)).alias("n"))


def _cluster_flow(s, d):
    out = W.find_clusters(read(s, d, "customer"), Roles(("c_acctbal", "c_nationkey"), id="c_custkey"), algorithm="dbscan", eps=0.05, order_by=["c_custkey"])
    return out.metrics.select("metric", F.round("value", 6).alias("value"))


QUERIES = {
    "rf_classify": (lambda s, d: _classify(s, d, "random_forest"), None),
    "gbt_classify": (lambda s, d: _classify(s, d, "gradient_boosting"), None),
    "svm_classify": (lambda s, d: _classify(s, d, "svm"), None),
    "logreg": (lambda s, d: _classify(s, d, "logistic_regression"), None),
    "rf_regress": (lambda s, d: _regress(s, d, "random_forest"), None),
    "gbt_regress": (lambda s, d: _regress(s, d, "gradient_boosting"), None),
    "svm_regress": (lambda s, d: _regress(s, d, "svm"), None),
    "linear_regress": (lambda s, d: _regress(s, d, "linear_regression"), None),
    "rf_multiclass": (lambda s, d: _multiclass(s, d, "random_forest"), None),
    "gbt_multiclass": (lambda s, d: _multiclass(s, d, "gradient_boosting"), None),
    "linear_regression_1d": (
        _ols,
        "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
    ),
    "class_weights": (
        _class_weights,
        "SELECT o_orderpriority, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)), 9) AS weight, count(*) AS n FROM orders GROUP BY 1",
    ),
    "importance": (_importance, None),
    "permutation_importance": (_permutation, None),
    "predict_batch": (_predict, None),
    "prepare_flow": (_prepare, None),
    "anomaly_flow_forest": (lambda s, d: _anomaly_flow(s, d, "isolation_forest"), None),
    "anomaly_flow_svm": (lambda s, d: _anomaly_flow(s, d, "one_class_svm"), None),
    "anomaly_flow_lof": (lambda s, d: _anomaly_flow(s, d, "local_outlier_factor"), None),
    "cluster_flow": (_cluster_flow, None),
    "noise_flow": (_noise_flow, None),
    "boundary_snapshot_points": (_snapshot_points, None),
    "boundary_snapshot_grid": (_snapshot_grid, None),
    "boundary_points": (_points, _POINTS_SQL),
    "cluster_points": (_cluster_points, _CLUSTER_POINTS_SQL),
    "surface_mesh": (_mesh, f"WITH p AS (SELECT x, y FROM {_GIVEN}), {_MESH} SELECT cell, round(x, 6) AS x, round(y, 6) AS y FROM g"),
    "cluster_grid": (_cluster_grid, _GRID_SQL),
    "boundary_stats": (lambda s, d: _stats(s, d, "classification"), _stats_sql(_POINTS_SQL, 0.6)),
    "cluster_stats": (lambda s, d: _stats(s, d, "clustering"), _stats_sql(_CLUSTER_POINTS_SQL, 0.4, _CLUSTER_STATS)),
    "prepare_stats": (_prepare_stats, _PREPARE_STATS_SQL),
}
