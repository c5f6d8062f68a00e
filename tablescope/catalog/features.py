"""Imputation, outlier filters, encoding and scaling."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.operators import prepare as P
from tablescope.operators.rows import drop_missing
from tablescope.plans.roles import PrepSpec

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = ", ".join(KEY)


def _lines(s, d):
    """Line items with gaps in two numeric columns and one text column."""
    n = F.col("l_linenumber")
    return read(s, d, "lineitem").select(
        *KEY, F.when(n == 3, F.lit(None)).when(n == 4, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(n != 5, F.col("l_tax")).alias("tax"), F.when(n % 3 != 0, F.col("l_returnflag")).alias("flag"),
        F.lit(2.5).alias("flat"), F.lit(None).cast("double").alias("none"),
    )


_LINES = f"""(SELECT {KEY_SQL}, CASE WHEN l_linenumber NOT IN (3, 4) THEN l_quantity END AS qty, CASE WHEN l_linenumber <> 5 THEN l_tax END AS tax,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS flag, 2.5::DOUBLE AS flat, NULL::DOUBLE AS none FROM lineitem)"""
_FEATURES = ["qty", "tax", "flag", "flat", "none"]
_FLAG_MODE = f"(SELECT flag FROM {_LINES} WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)"


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _impute(s, d, method):
    df = _lines(s, d)
    return _rounded(P.impute(df, P.fill_values(df, _FEATURES, method)), "qty", "tax")


def _impute_sql(qty, tax):
    return f"""SELECT {KEY_SQL}, round(coalesce(qty, {qty}), 6) AS qty, round(coalesce(tax, {tax}), 6) AS tax,
        coalesce(flag, {_FLAG_MODE}) AS flag, flat, 0.0::DOUBLE AS none FROM {_LINES}"""


def _fills(s, d):
    df = _lines(s, d)
    out = P.fill_values(df, _FEATURES, "median") | {"unknown": P.modes(df.withColumn("e", F.lit(None).cast("string")), ["e"])["e"]}
    cells = [F.struct(F.lit(k).alias("feature"), F.lit(str(v)).alias("fill")) for k, v in out.items()]
    return df.limit(1).select(F.inline(F.array(*cells)))


_FILLS_SQL = f"""
    SELECT 'qty' AS feature, CAST((SELECT quantile_cont(qty, 0.5) FROM {_LINES}) AS VARCHAR) AS fill
    UNION ALL SELECT 'tax', CAST((SELECT quantile_cont(tax, 0.5) FROM {_LINES}) AS VARCHAR)
    UNION ALL SELECT 'flag', {_FLAG_MODE} UNION ALL SELECT 'flat', '2.5' UNION ALL SELECT 'none', '0.0' UNION ALL SELECT 'unknown', 'unknown'"""


def _priced(s, d):
    """Prices with a long tail, gaps and a constant column."""
    return read(s, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.pow(F.col("o_totalprice") / 1000, F.lit(2.0))).alias("p"),
        (F.col("o_custkey") % 100).cast("double").alias("c"), F.lit(1.0).alias("flat"),
    )


_PRICED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN pow(o_totalprice / 1000, 2.0) END AS p, (o_custkey % 100)::DOUBLE AS c, 1.0::DOUBLE AS flat FROM orders)"""


def _iqr_prepare(s, d):
    spec = PrepSpec(handle_missing="mean", outlier_removal=True)
    return P.prepare_rows(_priced(s, d), ["p", "c", "flat"], spec).select("o_orderkey")


_IQR_PREPARE_SQL = f"""
    WITH i AS (SELECT o_orderkey, coalesce(p, (SELECT avg(p) FROM {_PRICED})) AS p, c FROM {_PRICED}),
    q AS (SELECT quantile_cont(p, 0.25) AS p1, quantile_cont(p, 0.75) AS p3, quantile_cont(c, 0.25) AS c1, quantile_cont(c, 0.75) AS c3 FROM i)
    SELECT o_orderkey FROM i, q WHERE p BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1) AND c BETWEEN c1 - 1.5 * (c3 - c1) AND c3 + 1.5 * (c3 - c1)"""


def _iqr_workflow(s, d):
    spec = PrepSpec(outlier_removal=True)
    return P.workflow_rows(_priced(s, d), ["p", "c", "flat"], None, spec).select("o_orderkey")


_IQR_WORKFLOW_SQL = f"""
    WITH q AS (SELECT quantile_cont(p, 0.25) AS p1, quantile_cont(p, 0.75) AS p3, quantile_cont(c, 0.25) AS c1, quantile_cont(c, 0.75) AS c3 FROM {_PRICED})
    SELECT o_orderkey FROM {_PRICED} i, q WHERE p BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1) AND c BETWEEN c1 - 1.5 * (c3 - c1) AND c3 + 1.5 * (c3 - c1)"""


def _quantiles(s, d):
    from tablescope.operators.ordering import exact_quantiles

    df = read(s, d, "lineitem")
    probs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    found = exact_quantiles(df, ["l_extendedprice", "l_quantity"], probs)
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(p).alias("p"), F.round(F.lit(v), 6).alias("value"))
        for c, vs in found.items() for p, v in zip(probs, vs)
    ]
    return df.limit(1).select(F.inline(F.array(*cells)))


_QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in ("l_extendedprice", "l_quantity") for p in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
)


def _scaled(s, d, method):
    df = read(s, d, "lineitem").select(*KEY, "l_quantity", "l_tax", F.lit(3.0).alias("flat"))
    return _rounded(P.scale(df, ["l_quantity", "l_tax", "flat"], method), "l_quantity", "l_tax")


_MINMAX_SQL = f"""
    WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) + 0.0 AS c, max(l_tax) AS e FROM lineitem)
    SELECT {KEY_SQL}, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_tax - c) / (e - c), 6) AS l_tax, 0.0::DOUBLE AS flat FROM lineitem, m"""
_STANDARD_SQL = f"""
    WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS e FROM lineitem)
    SELECT {KEY_SQL}, round((l_quantity - a) / b, 6) AS l_quantity, round((l_tax - c) / e, 6) AS l_tax, 0.0::DOUBLE AS flat FROM lineitem, m"""


def _label_encode(s, d):
    df = read(s, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_name").alias("name"))
    return P.label_encode(df, ["p_brand", "p_type", "name"])


_LABEL_SQL = """SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type,
    (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS name FROM part"""


def _label_wide(s, d):
    """More categories than fit an expression: the dictionary is joined."""
    return P.label_encode(read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"])


_LABEL_WIDE_SQL = "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer"


def _onehot(s, d):
    return P.onehot(read(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_ONEHOT_SQL = "SELECT c_custkey, " + ", ".join(f'(c_mktsegment = \'{v}\')::INT::DOUBLE AS "c_mktsegment_{v}"' for v in _SEGMENTS) + " FROM customer"


def _drop_missing(s, d):
    return drop_missing(_lines(s, d), ["qty", "tax", "flag"]).select(*KEY)


def _unseen(s, d):
    """Fitted on half of the rows, applied to all: unseen categories become -1."""
    df = read(s, d, "lineitem").select(
        *KEY, "l_quantity", F.concat("l_returnflag", (F.col("l_orderkey") % 4).cast("string")).alias("cat")
    )
    pre = P.fit_preprocessor(df.filter("l_orderkey % 4 < 2 AND l_quantity < 40"), ["l_quantity", "cat"], PrepSpec(), "workflow")
    return _rounded(pre.transform(df), "l_quantity")


_UNSEEN_SQL = f"""
    WITH x AS (SELECT {KEY_SQL}, l_quantity, l_returnflag || CAST(l_orderkey % 4 AS VARCHAR) AS cat FROM lineitem),
    t AS (SELECT * FROM x WHERE l_orderkey % 4 < 2 AND l_quantity < 40),
    m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM t),
    c AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS code FROM (SELECT DISTINCT cat FROM t))
    SELECT {KEY_SQL}, round((l_quantity - lo) / (hi - lo), 6) AS l_quantity, coalesce(c.code, -1)::DOUBLE AS cat FROM x LEFT JOIN c USING (cat), m"""


def _prepared_matrix(s, d):
    """Prepare preset: encoded columns are scaled too."""
    df = _lines(s, d)
    pre = P.fit_preprocessor(df, ["qty", "tax", "flag"], PrepSpec(handle_missing="zero"), "prepare")
    return _rounded(pre.transform(df), "qty", "tax", "flag").select(*KEY, "qty", "tax", "flag")


_PREPARED_SQL = f"""
    WITH i AS (SELECT {KEY_SQL}, coalesce(qty, 0) AS qty, coalesce(tax, 0) AS tax, coalesce(flag, {_FLAG_MODE}) AS flag FROM {_LINES}),
    e AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY flag) - 1 AS flag) FROM i),
    m AS (SELECT min(qty) AS q0, max(qty) AS q1, min(tax) AS t0, max(tax) AS t1, min(flag) AS f0, max(flag) AS f1 FROM e)
    SELECT {KEY_SQL}, round((qty - q0) / (q1 - q0), 6) AS qty, round((tax - t0) / (t1 - t0), 6) AS tax, round((flag - f0)::DOUBLE / (f1 - f0), 6) AS flag FROM e, m"""

QUERIES = {
    "impute_mean": (lambda s, d: _impute(s, d, "mean"), _impute_sql(f"(SELECT avg(qty) FROM {_LINES})", f"(SELECT avg(tax) FROM {_LINES})")),
    "impute_median": (
        lambda s, d: _impute(s, d, "median"),
        _impute_sql(f"(SELECT quantile_cont(qty, 0.5) FROM {_LINES})", f"(SELECT quantile_cont(tax, 0.5) FROM {_LINES})"),
    ),
    "impute_zero": (lambda s, d: _impute(s, d, "zero"), _impute_sql("0.0", "0.0")),
    "fill_values": (_fills, _FILLS_SQL),
    "exact_quantiles": (_quantiles, _QUANTILES_SQL),
    "drop_missing": (_drop_missing, f"SELECT {KEY_SQL} FROM {_LINES} WHERE qty IS NOT NULL AND tax IS NOT NULL AND flag IS NOT NULL"),
    "iqr_prepare": (_iqr_prepare, _IQR_PREPARE_SQL),
    "iqr_workflow": (_iqr_workflow, _IQR_WORKFLOW_SQL),
    "minmax": (lambda s, d: _scaled(s, d, "minmax"), _MINMAX_SQL),
    "standardize": (lambda s, d: _scaled(s, d, "standard"), _STANDARD_SQL),
    "label_encode": (_label_encode, _LABEL_SQL),
    "label_encode_wide": (_label_wide, _LABEL_WIDE_SQL),
    "onehot": (_onehot, _ONEHOT_SQL),
    "onehot_wide": (
        lambda s, d: P.onehot_rows(read(s, d, "customer"), ["c_custkey"], "c_name"),
        "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS position, 1.0::DOUBLE AS value FROM customer",
    ),
    "drop_null_label": (
        lambda s, d: P.workflow_rows(_lines(s, d), ["qty"], "flag", PrepSpec()).select(*KEY, "flag"),
        f"SELECT {KEY_SQL}, flag FROM {_LINES} WHERE flag IS NOT NULL",
    ),
    "preprocessor_unseen": (_unseen, _UNSEEN_SQL),
    "prepared_matrix": (_prepared_matrix, _PREPARED_SQL),
}
