"""Splits and metrics, on rule-based predictions."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.catalog.features import KEY, KEY_SQL
from tablescope.operators import metrics as M
from tablescope.operators.anomaly import anomaly_rank, anomaly_reason, flag_anomalies
from tablescope.operators.ordering import with_row_id
from tablescope.operators.split import train_test_split

_MD5 = "md5(CAST(o_orderkey AS VARCHAR) || '|42')"


def _split(s, d, **kw):
    return train_test_split(read(s, d, "orders"), ["o_orderkey"], **kw).select("o_orderkey", "_split_role")


def _split_sql(test, train):
    return f"""
        SELECT o_orderkey, CASE WHEN r <= {test} THEN 'test' WHEN r <= {test} + {train} THEN 'train' ELSE 'unused' END AS _split_role
        FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_MD5}) AS r, count(*) OVER () AS n FROM orders)"""


def _stratified_sql(label, test):
    """Largest remainder quotas per class, both parts adding up to all rows."""
    return f"""
        WITH c AS (SELECT {label} AS g, count(*) AS k, (SELECT count(*) FROM orders) AS n FROM orders GROUP BY 1),
        q AS (SELECT g, k, ceil({test} * n)::BIGINT AS want, k * ceil({test} * n)::BIGINT // n AS base, k * ceil({test} * n)::BIGINT % n AS rest FROM c),
        t AS (SELECT g, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, g) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
        SELECT o_orderkey, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS _split_role
        FROM (SELECT o_orderkey, {label} AS g, row_number() OVER (PARTITION BY {label} ORDER BY {_MD5}) AS r FROM orders) JOIN t USING (g)"""


def _tail(s, d):
    return train_test_split(with_row_id(read(s, d, "orders"), ["o_orderkey"]), ["o_orderkey"], test_size=0.25, shuffle=False).select("o_orderkey", "_split_role")


def _classified(s, d):
    """Return flags with a prediction by ship date, and a rule-based split."""
    day = F.dayofmonth("l_shipdate")
    return read(s, d, "lineitem").select(
        F.col("l_returnflag").alias("truth"), F.when(day % 3 == 0, F.lit("A")).when(day % 3 == 1, F.lit("N")).when(day < 29, F.lit("R")).otherwise(F.lit("X")).alias("_predicted_class"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("_split_role"), (day / 31.0).alias("conf"),
    )


_CLASSIFIED = """(SELECT l_returnflag AS truth, CASE WHEN day(l_shipdate) % 3 = 0 THEN 'A' WHEN day(l_shipdate) % 3 = 1 THEN 'N' WHEN day(l_shipdate) < 29 THEN 'R' ELSE 'X' END AS pred,
    CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, day(l_shipdate) / 31.0 AS conf FROM lineitem)"""


def _class_metrics(s, d):
    return M.class_metrics(_classified(s, d), "truth", "_predicted_class", confidence="conf").withColumn("value", F.round("value", 9))


_CLASS_METRICS_SQL = f"""
    WITH x AS (SELECT * FROM {_CLASSIFIED}),
    c AS (SELECT split, class, sum(s) AS s, sum(p) AS p, sum(h) AS h FROM (
        SELECT split, truth AS class, 1 AS s, 0 AS p, (truth = pred)::INT AS h FROM x UNION ALL SELECT split, pred, 0, 1, 0 FROM x) GROUP BY ALL),
    m AS (SELECT split, sum(h) / sum(s) AS accuracy, avg(h / s) FILTER (s > 0) AS balanced_accuracy,
                 sum(CASE WHEN p > 0 THEN s * h / p ELSE 0 END) / sum(s) AS precision, sum(CASE WHEN s > 0 THEN h ELSE 0 END) / sum(s) AS recall,
                 sum(s * 2 * h / (s + p)) / sum(s) AS f1, sum(s) AS n FROM c GROUP BY 1),
    l AS (UNPIVOT (SELECT split, accuracy::DOUBLE AS accuracy, balanced_accuracy::DOUBLE AS balanced_accuracy, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1 FROM m)
          ON accuracy, balanced_accuracy, precision, recall, f1 INTO NAME metric VALUE value)
    SELECT metric, round(value, 9) AS value FROM l WHERE split = 'test'
    UNION ALL SELECT split || '_' || metric, round(value, 9) FROM l
    UNION ALL SELECT split || '_count', n::DOUBLE FROM m UNION ALL SELECT 'unused_count', 0.0
    UNION ALL SELECT 'confidence_mean', round(avg(conf), 9) FROM x WHERE split = 'test'
    UNION ALL SELECT 'train_confidence_mean', round(avg(conf), 9) FROM x WHERE split = 'train'"""


def _confusion(s, d):
    return M.confusion_matrix(_classified(s, d).filter("_split_role = 'test'"), "truth", "_predicted_class")


_CONFUSION_SQL = f"""
    WITH x AS (SELECT truth, pred FROM {_CLASSIFIED} WHERE split = 'test'), l AS (SELECT truth AS v FROM x UNION SELECT pred FROM x)
    SELECT a.v AS truth, b.v AS prediction, count(x.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN x ON x.truth = a.v AND x.pred = b.v GROUP BY 1, 2"""


def _classification_columns(s, d):
    return M.classification_columns(_classified(s, d), "truth").groupBy("truth", "_split_role", "_is_correct", "_error_flag").agg(F.count(F.lit(1)).alias("n"))


_CLASS_COLUMNS_SQL = f"""SELECT truth, split AS _split_role, truth = pred AS _is_correct, split = 'test' AND truth <> pred AS _error_flag, count(*) AS n FROM {_CLASSIFIED} GROUP BY ALL"""


def _regressed(s, d):
    return read(s, d, "lineitem").select(
        *KEY, F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0 + F.col("l_linenumber") * 10).alias("_predicted_value"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).when(F.col("l_orderkey") % 5 == 1, F.lit("unused")).otherwise(F.lit("train")).alias("_split_role"),
    )


_REGRESSED = f"""(SELECT {KEY_SQL}, l_extendedprice AS y, l_quantity * 2000.0 + l_linenumber * 10 AS pred,
    CASE WHEN l_orderkey % 5 = 0 THEN 'test' WHEN l_orderkey % 5 = 1 THEN 'unused' ELSE 'train' END AS split FROM lineitem)"""


def _regression_metrics(s, d):
    return M.regression_metrics(_regressed(s, d), "y", "_predicted_value").withColumn("value", F.round("value", 5))


_REGRESSION_METRICS_SQL = f"""
    WITH m AS (SELECT split, avg(abs(y - pred)) AS mae, sqrt(avg(pow(y - pred, 2))) AS rmse, 1 - avg(pow(y - pred, 2)) / var_pop(y) AS r2,
                      avg(y - pred) AS residual_mean, stddev_pop(y - pred) AS residual_std, count(*)::DOUBLE AS n FROM {_REGRESSED} GROUP BY 1),
    l AS (UNPIVOT (SELECT split, mae, rmse, r2 FROM m) ON mae, rmse, r2 INTO NAME metric VALUE value)
    SELECT metric, round(value, 5) AS value FROM l WHERE split = 'test' UNION ALL SELECT split || '_' || metric, round(value, 5) FROM l WHERE split <> 'unused'
    UNION ALL SELECT split || '_count', n FROM m
    UNION ALL SELECT 'residual_mean', round(residual_mean, 5) FROM m WHERE split = 'test' UNION ALL SELECT 'residual_std', round(residual_std, 5) FROM m WHERE split = 'test'"""


def _error_flag(s, d):
    out = M.regression_columns(_regressed(s, d), "y")
    return out.select(*KEY, "_actual_value", F.round("_residual", 4).alias("_residual"), F.round("_absolute_error", 4).alias("_absolute_error"), "_error_flag")


_ERROR_FLAG_SQL = f"""
    WITH q AS (SELECT quantile_cont(abs(y - pred), 0.9) AS cut FROM {_REGRESSED} WHERE split = 'test')
    SELECT {KEY_SQL}, y AS _actual_value, round(y - pred, 4) AS _residual, round(abs(y - pred), 4) AS _absolute_error, split = 'test' AND abs(y - pred) >= cut AS _error_flag FROM {_REGRESSED}, q"""


def _scored(s, d):
    """A given score per order and labels in mixed spelling."""
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"),
        F.when(k % 4 == 0, F.lit(" Yes")).when(k % 4 == 1, F.lit("ANOMALY")).when(k % 4 == 2, F.lit("no ")).otherwise(F.lit("clean")).alias("label"),
        F.when(k % 4 == 0, F.lit("maybe")).otherwise(F.lit("no")).alias("odd"),
    )


_SCORED = """(SELECT o_orderkey, floor(o_totalprice / 1000)::DOUBLE AS score, o_orderkey % 4 < 2 AS y FROM orders)"""


def _anomalies(s, d):
    return flag_anomalies(_scored(s, d), "score", 0.1, shift=False)


def _anomaly_metrics(s, d, label):
    return M.anomaly_metrics(_anomalies(s, d), "score", "_is_anomaly", 0.1, label).withColumn("value", F.round("value", 6))


_ANOMALY_BASE = f"""WITH q AS (SELECT quantile_cont(score, 0.9) AS cut FROM {_SCORED}), x AS (SELECT *, score > cut AS f FROM {_SCORED}, q)"""
_ANOMALY_METRICS_SQL = f"""{_ANOMALY_BASE}
    SELECT 'anomaly_count' AS metric, count(*) FILTER (f)::DOUBLE AS value FROM x UNION ALL SELECT 'anomaly_rate', round(count(*) FILTER (f) / count(*), 6) FROM x
    UNION ALL SELECT 'score_mean', round(avg(score), 6) FROM x UNION ALL SELECT 'score_p90', round(cut, 6) FROM q UNION ALL SELECT 'threshold', round(cut, 6) FROM q"""
_ANOMALY_LABEL_SQL = f"""{_ANOMALY_METRICS_SQL}
    UNION ALL SELECT 'precision', round(count(*) FILTER (f AND y) / count(*) FILTER (f), 6) FROM x UNION ALL SELECT 'recall', round(count(*) FILTER (f AND y) / count(*) FILTER (y), 6) FROM x
    UNION ALL SELECT 'f1', round(2 * count(*) FILTER (f AND y) / (count(*) FILTER (f) + count(*) FILTER (y)), 6) FROM x"""


def _anomaly_columns(s, d):
    ranked = anomaly_rank(_anomalies(s, d), "score", ["o_orderkey"])
    return ranked.select("o_orderkey", "_anomaly_score", "_is_anomaly", "_anomaly_rank", anomaly_reason(F.col("_is_anomaly")).alias("_anomaly_reason"))


_ANOMALY_COLUMNS_SQL = f"""{_ANOMALY_BASE}
    SELECT o_orderkey, score AS _anomaly_score, f AS _is_anomaly, row_number() OVER (ORDER BY score DESC, o_orderkey) AS _anomaly_rank,
           CASE WHEN f THEN 'score_above_threshold' ELSE 'within_normal_range' END AS _anomaly_reason FROM x"""


def _binary(s, d):
    return _scored(s, d).groupBy("label", "odd").agg(F.min(M.binary_label(F.col("label"))).alias("y"), F.min(M.binary_label(F.col("odd"))).alias("z"), F.count(F.lit(1)).alias("n"))


_BINARY_SQL = """SELECT [' Yes', 'ANOMALY', 'no ', 'clean'][(o_orderkey % 4 + 1)::INT] AS label, CASE WHEN o_orderkey % 4 = 0 THEN 'maybe' ELSE 'no' END AS odd,
    (o_orderkey % 4 < 2)::INT AS y, CASE WHEN o_orderkey % 4 > 0 THEN 0 END AS z, count(*) AS n FROM orders GROUP BY o_orderkey % 4"""


def _confidence(s, d):
    t, q = F.col("l_tax"), F.col("l_discount")
    return read(s, d, "lineitem").select(
        *KEY, F.round(M.confidence_from_scores(probability=F.array(t, q)), 9).alias("from_probability"),
        F.round(M.confidence_from_scores(margins=F.array(t - q)), 9).alias("from_margin"),
        F.round(M.confidence_from_scores(margins=F.array(t, q, F.lit(0.01))), 9).alias("from_scores"), M.confidence_from_scores().alias("without"),
    )


_CONFIDENCE_SQL = f"""SELECT {KEY_SQL}, round(greatest(l_tax, l_discount), 9) AS from_probability, round(1 / (1 + exp(-abs(l_tax - l_discount))), 9) AS from_margin,
    round(exp(greatest(l_tax, l_discount, 0.01)) / (exp(l_tax) + exp(l_discount) + exp(0.01)), 9) AS from_scores, 0.5::DOUBLE AS without FROM lineitem"""

QUERIES = {
    "split_ratio": (lambda s, d: _split(s, d), _split_sql("ceil(0.2 * n)", "n")),
    "split_ratio_unused": (lambda s, d: _split(s, d, test_size=0.2, train_size=0.5), _split_sql("ceil(0.2 * n)", "floor(0.5 * n)")),
    "split_count": (lambda s, d: _split(s, d, mode="count", test_size=100, train_size=300), _split_sql("100", "300")),
    "split_stratified": (lambda s, d: _split(s, d, label="o_orderpriority"), _stratified_sql("o_orderpriority", 0.2)),
    "split_infeasible": (lambda s, d: _split(s, d, label="o_orderkey"), _split_sql("ceil(0.2 * n)", "n")),
    "split_tail": (
        _tail,
        "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= count(*) OVER () - ceil(0.25 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS _split_role FROM orders",
    ),
    "class_metrics": (_class_metrics, _CLASS_METRICS_SQL),
    "confusion_matrix": (_confusion, _CONFUSION_SQL),
    "confusion_matrix_wide": (
        lambda s, d: M.confusion_matrix(read(s, d, "lineitem").select("l_partkey", (F.col("l_partkey") % 500).alias("guess")), "l_partkey", "guess", dense=False),
        "SELECT l_partkey::VARCHAR AS truth, (l_partkey % 500)::VARCHAR AS prediction, count(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "classification_columns": (_classification_columns, _CLASS_COLUMNS_SQL),
    "regression_metrics": (_regression_metrics, _REGRESSION_METRICS_SQL),
    "error_flag": (_error_flag, _ERROR_FLAG_SQL),
    "anomaly_metrics": (lambda s, d: _anomaly_metrics(s, d, "label"), _ANOMALY_LABEL_SQL),
    "anomaly_metrics_unlabelled": (lambda s, d: _anomaly_metrics(s, d, "odd"), _ANOMALY_METRICS_SQL),
    "anomaly_columns": (_anomaly_columns, _ANOMALY_COLUMNS_SQL),
    "binary_labels": (_binary, _BINARY_SQL),
    "confidence_fallback": (_confidence, _CONFIDENCE_SQL),
}
