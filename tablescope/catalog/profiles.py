"""Profiles and target feasibility."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.operators import profile as P
from tablescope.operators import signal as G
from tablescope.operators import target as T

_LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp",
}
_ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp", "o_orderpriority": "string",
}


def _gaps(df):
    """Orders with a sparse column, a constant column and some missing prices."""
    return df.select(
        "*", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("sparse"), F.lit("same").alias("constant"),
        F.when(F.col("o_orderkey") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("holes"),
    )


_GAPS_SQL = (
    "(SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS sparse, 'same' AS constant, "
    "CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS holes FROM orders)"
)


def _flags_out(df):
    return df.withColumns({
        "warning_flags": F.array_join("warning_flags", ","),
        "missing_rate": F.round("missing_rate", 9), "unique_ratio": F.round("unique_ratio", 9),
    }).drop("inferred_type")


def _profile_sql(source, columns):
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) AS d FROM {source}"
        )
    return f"""
        SELECT position, name, round(m / n, 9) AS missing_rate, d AS unique_count, round(d / n, 9) AS unique_ratio,
               d <= 1 AS low_variance, (d / n > 0.9 AND d >= 20) AS likely_identifier,
               concat_ws(',', CASE WHEN m / n >= 0.4 THEN 'high_missing_rate' END, CASE WHEN d <= 1 THEN 'low_variance' END,
                         CASE WHEN d / n > 0.9 AND d >= 20 THEN 'likely_identifier' END) AS warning_flags,
               n AS row_count
        FROM ({' UNION ALL '.join(parts)})"""


def _info_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, '{t}' AS inferred_type, count(*) - count({c}) AS missing_count FROM {source}"
        for i, (c, t) in enumerate(columns.items())
    )


def _info(df):
    """Timestamps are reported alike whether the reader keeps a time zone or not."""
    out = P.column_info(df)
    return out.withColumn("inferred_type", F.regexp_replace("inferred_type", "_ntz$", ""))


def _sheet_sql(source, columns):
    rates = " + ".join(f"(count(*) - count({c})) / count(*)" for c in columns)
    return f"SELECT count(*) AS row_count, {len(columns)}::BIGINT AS column_count, round(({rates}) / {len(columns)}, 9) AS missing_rate_overall FROM {source}"


def _class_sql(source, labels):
    parts = [
        f"SELECT '{c}' AS target_column, v AS class, count(*) AS n FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {source}) GROUP BY 2"
        for c in labels
    ]
    return f"""
        WITH c AS ({' UNION ALL '.join(parts)}),
        s AS (SELECT target_column, coalesce(sum(n) FILTER (class IS NOT NULL), 0) AS n, max(n) FILTER (class IS NOT NULL) AS top,
                     min(n) FILTER (class IS NOT NULL) AS low, count(class) AS classes FROM c GROUP BY 1)
        SELECT target_column, 'classification' AS target_kind,
               CASE WHEN n = 0 OR classes <= 1 OR low < 5 THEN 'low' WHEN top / n > 0.9 THEN 'medium' ELSE 'high' END AS feasibility,
               CASE WHEN n > 0 THEN round(top / n, 9) END AS baseline_accuracy, classes,
               concat_ws(',', CASE WHEN n = 0 THEN 'empty_target' END, CASE WHEN n > 0 AND classes <= 1 THEN 'single_class_target' END,
                         CASE WHEN low < 5 THEN 'minority_class_too_small' END, CASE WHEN top / n > 0.9 THEN 'class_imbalance' END) AS warnings
        FROM s"""


def _class_out(df):
    return df.withColumns({"warnings": F.array_join("warnings", ","), "baseline_accuracy": F.round("baseline_accuracy", 9)})


def _targets(df):
    """Derived labels: rare class, dominant class, empty, single."""
    return df.select(
        "*", F.when(F.col("o_orderkey") == 1, F.lit("rare")).otherwise(F.lit("usual")).alias("rare"),
        F.when(F.col("o_orderkey") % 20 == 1, F.lit("few")).otherwise(F.lit("most")).alias("uneven"),
        F.lit(None).cast("string").alias("empty"), F.lit("x").alias("single"),
    )


_TARGETS_SQL = (
    "(SELECT *, CASE WHEN o_orderkey = 1 THEN 'rare' ELSE 'usual' END AS rare, CASE WHEN o_orderkey % 20 = 1 THEN 'few' ELSE 'most' END AS uneven, "
    "NULL::VARCHAR AS empty, 'x' AS single FROM orders)"
)
_CLASS_LABELS = ["o_orderstatus", "o_orderpriority", "rare", "uneven", "empty", "single"]


def _regression_out(df):
    return df.withColumns({
        "warnings": F.array_join("warnings", ","), **{c: F.round(c, 4) for c in ("baseline_mae", "baseline_rmse", "missing_rate")}
    })


def _regression_sql(source, columns):
    parts = []
    for c in columns:
        v = f"TRY_CAST({c} AS DOUBLE)"
        parts.append(f"""
            SELECT '{c}' AS target_column, 'regression' AS target_kind,
                   CASE WHEN count({v}) = 0 OR stddev_pop({v}) <= 1e-8 THEN 'low' ELSE 'high' END AS feasibility,
                   round(avg(abs({v} - (SELECT avg({v}) FROM {source}))), 4) AS baseline_mae, round(stddev_pop({v}), 4) AS baseline_rmse,
                   round(1 - count({v}) / count(*), 4) AS missing_rate,
                   concat_ws(',', CASE WHEN count({v}) = 0 THEN 'non_numeric_target' END,
                             CASE WHEN stddev_pop({v}) <= 1e-8 THEN 'near_constant_target' END) AS warnings
            FROM {source}""")
    return " UNION ALL ".join(parts)


def _regression_source(df):
    return df.select("l_extendedprice", "l_quantity", "l_returnflag", F.lit(7.0).alias("seven"),
                     F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("gappy"))


_REGRESSION_SQL = (
    "(SELECT l_extendedprice, l_quantity, l_returnflag, 7.0::DOUBLE AS seven, CASE WHEN l_linenumber <> 3 THEN l_tax END AS gappy FROM lineitem)"
)


def _kind_source(df):
    return df.select(
        "c_custkey", "c_acctbal", "c_mktsegment", F.regexp_replace("c_name", "Customer#", "").alias("digits"),
        F.when(F.col("c_custkey") % 10 < 2, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("mixed"),
    )


_KIND_SQL = (
    "(SELECT c_custkey, c_acctbal, c_mktsegment, replace(c_name, 'Customer#', '') AS digits, "
    "CASE WHEN c_custkey % 10 < 2 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS mixed FROM customer)"
)
_KINDS = ["c_custkey", "c_acctbal", "c_mktsegment", "digits", "mixed"]

def _signal_source(df):
    """Line items with an identifier, a sparse, a constant and a text column of many values."""
    return df.select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_tax", "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ident"),
        F.when(F.col("l_linenumber") == 1, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("sparse"), F.lit("same").alias("constant"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("y"),
    )


_SIGNAL_SQL = """(SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_tax, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS ident, CASE WHEN l_linenumber = 1 THEN l_discount END AS sparse, 'same' AS constant,
    CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END END AS y FROM lineitem)"""
_SIGNAL_NUMBERS = ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "sparse"]
_SIGNAL_TEXTS = ["l_linestatus", "day", "ident", "constant"]


def _signal_sql(label, numbers, texts, regression, categories):
    """Mutual information by its definition, from bins and the most frequent texts."""
    def binned(c):
        return f"CASE WHEN {c} IS NOT NULL THEN len(list_filter(list_distinct((SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM d)), lambda q: {c} > q))::VARCHAR END"

    target = binned(label) if regression else label
    parts = [f"SELECT '{c}' AS feature, {binned(c)} AS part, {target} AS class FROM d" for c in numbers]
    for c in texts:
        top = f"(SELECT {c} AS v FROM d WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {categories})"
        parts.append(f"SELECT '{c}' AS feature, CASE WHEN {c} IS NULL THEN NULL WHEN t.v IS NULL THEN '~rest' ELSE 'v' || {c} END AS part, {target} AS class FROM d LEFT JOIN {top} t ON t.v = {c}")
    flags = _profile_sql(_SIGNAL_SQL, [*numbers, *texts])
    corr = " ".join(f"UNION ALL SELECT '{c}', 'correlation', corr({c}, {label}) FROM d" for c in numbers) if regression else ""
    return f"""
        WITH d AS (SELECT * FROM {_SIGNAL_SQL} WHERE {label} IS NOT NULL),
        j AS ({' UNION ALL '.join(parts)}),
        c AS (SELECT feature, part, class, count(*) AS n FROM j GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY feature, part) AS np, sum(n) OVER (PARTITION BY feature, class) AS nc, sum(n) OVER (PARTITION BY feature) AS total FROM c),
        s AS (SELECT feature, 'mutual_information' AS score_kind, sum(n / total * ln(n * total / (np * nc::DOUBLE))) AS score FROM t GROUP BY 1 {corr})
        SELECT s.feature, score_kind, round(abs(score) * sign(score), 6) + 0 AS score, warning_flags FROM s JOIN ({flags}) f ON f.name = s.feature"""


def _signal(s, d, label, regression, categories):
    df = _signal_source(read(s, d, "lineitem"))
    out = G.feature_signal(df, [*_SIGNAL_NUMBERS, *_SIGNAL_TEXTS], label, "regression" if regression else "auto", categories=categories)
    return out.withColumns({"score": F.round("score", 6) + F.lit(0.0), "warning_flags": F.array_join("warning_flags", ",")})


QUERIES = {
    "feature_signal": (
        lambda s, d: _signal(s, d, "l_returnflag", False, 100), _signal_sql("l_returnflag", _SIGNAL_NUMBERS, _SIGNAL_TEXTS, False, 100)
    ),
    "feature_signal_regression": (
        lambda s, d: _signal(s, d, "y", True, 20), _signal_sql("y", _SIGNAL_NUMBERS, _SIGNAL_TEXTS, True, 20)
    ),
    "data_profile": (lambda s, d: _flags_out(P.data_profile(read(s, d, "lineitem"))), _profile_sql("lineitem", _LINEITEM)),
    "data_profile_flags": (
        lambda s, d: _flags_out(P.data_profile(_gaps(read(s, d, "orders")))),
        _profile_sql(_GAPS_SQL, [*_ORDERS, "sparse", "constant", "holes"]),
    ),
    "column_info": (lambda s, d: _info(read(s, d, "lineitem")), _info_sql("lineitem", _LINEITEM)),
    "column_info_gaps": (
        lambda s, d: _info(_gaps(read(s, d, "orders"))),
        _info_sql(_GAPS_SQL, {**_ORDERS, "sparse": "double", "constant": "string", "holes": "double"}),
    ),
    "sheet_profile": (
        lambda s, d: P.sheet_profile(_gaps(read(s, d, "orders"))).withColumn("missing_rate_overall", F.round("missing_rate_overall", 9)),
        _sheet_sql(_GAPS_SQL, [*_ORDERS, "sparse", "constant", "holes"]),
    ),
    "class_feasibility": (
        lambda s, d: _class_out(T.class_feasibility(_targets(read(s, d, "orders")), _CLASS_LABELS)), _class_sql(_TARGETS_SQL, _CLASS_LABELS)
    ),
    "class_feasibility_lineitem": (
        lambda s, d: _class_out(T.class_feasibility(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])),
        _class_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]),
    ),
    "class_feasibility_labels": (
        lambda s, d: _class_out(T.class_feasibility(read(s, d, "labels"), ["quality", "toxic"])), _class_sql("labels", ["quality", "toxic"])
    ),
    "regression_feasibility": (
        lambda s, d: _regression_out(T.regression_feasibility(_regression_source(read(s, d, "lineitem")), ["l_extendedprice", "l_quantity", "l_returnflag", "seven", "gappy"])),
        _regression_sql(_REGRESSION_SQL, ["l_extendedprice", "l_quantity", "l_returnflag", "seven", "gappy"]),
    ),
    "target_kind": (
        lambda s, d: T.target_kind(_kind_source(read(s, d, "customer")), [*_KINDS, "absent"]),
        " UNION ALL ".join(
            f"SELECT '{c}' AS target_column, CASE WHEN count(TRY_CAST({c} AS DOUBLE)) / count(*) >= 0.95 THEN 'regression' ELSE 'classification' END AS target_kind FROM {_KIND_SQL}"
            for c in _KINDS
        ) + " UNION ALL SELECT 'absent', 'unknown'",
    ),
}
