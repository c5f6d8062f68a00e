"""Popularity recommendations over orders, line items and events."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.operators import recommend as R


def _bought(s, d):
    lines = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(read(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def _brands(s, d):
    parts = read(s, d, "part").select("p_partkey", "p_brand")
    return _bought(s, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_brand", "l_quantity")


_BOUGHT = "(SELECT o_custkey AS u, CAST(l_partkey AS VARCHAR) AS i, l_quantity AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_BRANDS = "(SELECT o_custkey AS u, p_brand AS i, l_quantity AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
_EVENTS = """(SELECT user_id AS u, event_type AS i, 1 AS r FROM events
    WHERE event_type <> ['click', 'error', 'purchase', 'signup', 'view'][(user_id % 5 + 1)::INT])"""


def _scores_sql(source, rated):
    score = "avg(r) + 0.01 * count(r)" if rated else "count(*)::DOUBLE"
    return f"SELECT i AS item, {score} AS score FROM {source} GROUP BY 1"


def _recommend_sql(source, user, rated, k):
    return f"""
        WITH s AS ({_scores_sql(source, rated)}), seen AS (SELECT DISTINCT u, i FROM {source}),
        open AS (SELECT u, item, score FROM (SELECT DISTINCT u FROM seen) CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.u = u.u AND x.i = item)),
        r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, item) AS k FROM open)
        SELECT u AS {user}, item AS recommended_item_id, round(score, 6) AS _recommendation_score, k AS _rank, 'popularity_baseline' AS _recommendation_reason FROM r WHERE k <= {k}""".replace(
        "(SELECT DISTINCT u FROM seen) CROSS JOIN s WHERE", "(SELECT DISTINCT u FROM seen) u CROSS JOIN s WHERE"
    ).replace("open AS (SELECT u, item", "open AS (SELECT u.u AS u, item")


def _out(df):
    return df.withColumn("_recommendation_score", F.round("_recommendation_score", 6))


def _events(s, d):
    """Users that did not do everything: one event type is dropped per user."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    dropped = F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int"))
    return read(s, d, "events").filter(F.col("event_type") != dropped)


def _metrics(s, d):
    df = _brands(s, d)
    made = R.recommend(df, "o_custkey", "p_brand", "l_quantity", 5)
    return R.recommendation_metrics(df, made, "o_custkey", "p_brand", 5).withColumn("value", F.round("value", 6))


_METRICS_SQL = f"""
    WITH r AS ({_recommend_sql(_BRANDS, 'o_custkey', True, 5)})
    SELECT 'user_count' AS metric, count(DISTINCT u)::DOUBLE AS value FROM {_BRANDS} UNION ALL SELECT 'item_count', count(DISTINCT i)::DOUBLE FROM {_BRANDS}
    UNION ALL SELECT 'recommendation_count', count(*)::DOUBLE FROM r UNION ALL SELECT 'top_k', 5.0
    UNION ALL SELECT 'coverage', round(count(DISTINCT recommended_item_id) / (SELECT count(DISTINCT i) FROM {_BRANDS}), 6) FROM r"""

QUERIES = {
    "item_scores": (
        lambda s, d: R.item_scores(_bought(s, d), "l_partkey", "l_quantity").withColumn("score", F.round("score", 6)),
        f"SELECT item, round(score, 6) AS score FROM ({_scores_sql(_BOUGHT, True)})",
    ),
    "item_scores_unrated": (lambda s, d: R.item_scores(read(s, d, "events"), "event_type"), "SELECT event_type AS item, count(*)::DOUBLE AS score FROM events GROUP BY 1"),
    "recommend_rated": (lambda s, d: _out(R.recommend(_bought(s, d), "o_custkey", "l_partkey", "l_quantity", 5)), _recommend_sql(_BOUGHT, "o_custkey", True, 5)),
    "recommend_brands": (lambda s, d: _out(R.recommend(_brands(s, d), "o_custkey", "p_brand", "l_quantity", 5)), _recommend_sql(_BRANDS, "o_custkey", True, 5)),
    "recommend_popular": (lambda s, d: _out(R.recommend(_events(s, d), "user_id", "event_type", None, 2)), _recommend_sql(_EVENTS, "user_id", False, 2)),
    "recommend_metrics": (_metrics, _METRICS_SQL),
}
