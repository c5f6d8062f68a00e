"""Row tools, lookups and noise rows."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.functions.values import canon_str, json_safe, to_numeric
from tablescope.operators import lookup as L
from tablescope.operators import noise as N
from tablescope.operators import ranges as O
from tablescope.operators import rows as R
from tablescope.operators.ordering import with_row_id
from tablescope.sources.tables import json_rows

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINE_KEY_SQL = ", ".join(LINE_KEY)


def _day(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


def _numbered_part(s, d):
    return with_row_id(read(s, d, "part"), ["p_partkey"])


def _orders_page(s, d):
    orders = read(s, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    return R.page(with_row_id(orders, ["o_orderkey"]), 40, 100)


def _edit_log(s, d):
    """Edits derived from the table: set, clear, delete, insert by key."""
    base = read(s, d, "part").select(F.col("p_partkey").alias("_row_id"), "p_size", "p_name")
    k = F.col("_row_id")

    def edit(rows, op, column, value):
        return rows.select("_row_id", F.lit(op).alias("op"), F.lit(column).cast("string").alias("column"), value.cast("string").alias("value"))

    null = F.lit(None)
    new = base.filter(k % 50 == 7).withColumn("_row_id", k + 100_000_000)
    return (
        edit(base.filter(k % 10 == 1), "set", "p_size", F.col("p_size") + 1000)
        .unionByName(edit(base.filter(k % 10 == 2), "clear", "p_name", null))
        .unionByName(edit(base.filter(k % 10 == 3), "delete", None, null))
        .unionByName(edit(new, "insert", None, null))
        .unionByName(edit(new, "set", "p_name", F.concat(F.lit("new "), "p_name")))
    )


def _apply_edits(s, d):
    rows = read(s, d, "part").select(F.col("p_partkey").alias("_row_id"), "p_name", "p_size", "p_retailprice")
    return R.apply_edits(rows, _edit_log(s, d))


_EDITS_SQL = """
    SELECT p_partkey AS _row_id, CASE WHEN p_partkey % 10 <> 2 THEN p_name END AS p_name,
           CASE WHEN p_partkey % 10 = 1 THEN p_size + 1000 ELSE p_size END AS p_size, p_retailprice
    FROM part WHERE p_partkey % 10 <> 3
    UNION ALL SELECT p_partkey + 100000000, 'new ' || p_name, NULL, NULL FROM part WHERE p_partkey % 50 = 7"""


def _ordered_log(s, d):
    """Several edits of one cell, of a deleted row, of a row inserted again, of one inserted twice and of new rows."""
    k = F.col("_row_id")
    base = read(s, d, "part").select(F.col("p_partkey").alias("_row_id"))
    plans = {
        0: [("set", "p_size", "1"), ("set", "p_size", "2"), ("clear", "p_size", None), ("set", "p_size", "7")],
        1: [("set", "p_name", "x"), ("set", "p_size", "9"), ("clear", "p_name", None)],
        2: [("set", "p_size", "8"), ("delete", None, None), ("set", "p_size", "4"), ("insert", None, None), ("set", "p_name", "back"), ("set", "p_size", "bad")],
        3: [("set", "p_size", "5"), ("delete", None, None), ("set", "p_size", "6")],
        4: [("set", "p_name", "early"), ("insert", None, None), ("insert", None, None), ("set", "p_size", "9")],
        5: [("delete", None, None), ("insert", None, None), ("set", "p_name", "y"), ("delete", None, None)],
    }
    fresh = [("set", "p_name", "too early"), ("insert", None, None), ("set", "p_size", "3"), ("set", "p_size", "30")]

    def log(rows, plan):
        steps = [F.struct(F.lit(n).alias("seq"), F.lit(o).alias("op"), F.lit(c).cast("string").alias("column"), F.lit(v).cast("string").alias("value")) for n, (o, c, v) in enumerate(plan)]
        return rows.select("_row_id", F.inline(F.array(*steps)))

    out = log(base.filter(k % 50 == 7).withColumn("_row_id", k + 100_000_000), fresh)
    for rest, plan in plans.items():
        out = out.unionByName(log(base.filter(k % 7 == rest), plan))
    return out


def _apply_ordered(s, d):
    rows = read(s, d, "part").select(F.col("p_partkey").alias("_row_id"), "p_name", "p_size", "p_retailprice")
    return R.apply_edits(rows, _ordered_log(s, d), sequence="seq")


_ORDERED_SQL = """
    SELECT p_partkey AS _row_id, CASE p_partkey % 7 WHEN 1 THEN NULL WHEN 2 THEN 'back' WHEN 4 THEN 'early' ELSE p_name END AS p_name,
           CASE p_partkey % 7 WHEN 0 THEN 7 WHEN 1 THEN 9 WHEN 2 THEN NULL WHEN 4 THEN 9 ELSE p_size END AS p_size, CASE WHEN p_partkey % 7 <> 2 THEN p_retailprice END AS p_retailprice
    FROM part WHERE p_partkey % 7 NOT IN (3, 5)
    UNION ALL SELECT p_partkey + 100000000, NULL, 30, NULL FROM part WHERE p_partkey % 50 = 7"""


def _hlookup(s, d):
    """A table whose first row names its columns: key, row index and hits vary with the order."""
    table = _numbered_part(s, d).select("_row_id", "p_name", "p_size", F.col("p_retailprice").cast("int").cast("string").alias("price"))
    head = table.limit(1).select(F.lit(0).cast("bigint").alias("_row_id"), F.lit("name").alias("p_name"), F.lit(1).alias("p_size"), F.lit("2.5").alias("price"))
    named = head.unionByName(table).withColumn("_row_id", F.col("_row_id") + 1)
    k = F.col("o_orderkey")
    asked = read(s, d, "orders").select(
        "o_orderkey", F.element_at(F.array(F.lit("name"), F.lit("1"), F.lit("2.5"), F.lit("none")), (k % 4 + 1).cast("int")).alias("k"),
        F.when(k % 13 == 0, F.lit("x")).when(k % 17 == 0, F.lit("0")).otherwise((F.col("o_custkey") + 0.5).cast("string")).alias("r"))
    return L.hlookup(asked, "k", named, F.col("r")).select("o_orderkey", "hlookup", "hlookup_err")


_HLOOKUP_SQL = """
    WITH t AS (SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS r, p_name, p_size::VARCHAR AS p_size, trunc(p_retailprice)::INT::VARCHAR AS price FROM part
               UNION ALL SELECT 1, 'name', '1', '2.5'),
    a AS (SELECT o_orderkey, o_orderkey % 4 AS c, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL WHEN o_custkey >= 1 THEN o_custkey END AS r FROM orders)
    SELECT o_orderkey, CASE WHEN a.r IS NOT NULL AND t.r IS NOT NULL THEN CASE c WHEN 0 THEN p_name WHEN 1 THEN p_size WHEN 2 THEN price END END AS hlookup,
           CASE WHEN a.r IS NULL THEN '#VALUE!' WHEN c = 3 THEN '#N/A' WHEN t.r IS NULL THEN '#REF!' END AS hlookup_err FROM a LEFT JOIN t ON t.r = a.r"""


def _offset_table(s, d):
    return _numbered_part(s, d).select("_row_id", "p_size", "p_name", F.floor("p_retailprice").cast("double").alias("price"))


def _offset(s, d):
    k = F.col("o_orderkey")
    asked = read(s, d, "orders").select("o_orderkey", "o_custkey")
    down = F.when(k % 19 == 0, F.lit("x")).otherwise((k % 5 - 3).cast("string"))
    return O.offset_cell(asked, _offset_table(s, d), F.col("o_custkey"), F.lit(1), down, k % 4).select("o_orderkey", "offset", "offset_err")


_OFFSET_SQL = """
    WITH t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_size::VARCHAR AS a, p_name AS b, printf('%.1f', floor(p_retailprice)) AS c FROM part),
    q AS (SELECT o_orderkey, o_orderkey % 19 = 0 AS bad, o_custkey + o_orderkey % 5 - 3 AS r, o_orderkey % 4 AS c FROM orders)
    SELECT o_orderkey, CASE WHEN NOT bad THEN CASE q.c WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN t.c END END AS "offset",
           CASE WHEN bad THEN '#VALUE!' WHEN t.r IS NULL OR q.c = 3 THEN '#REF!' END AS offset_err FROM q LEFT JOIN t ON t.r = q.r"""


def _offset_range(s, d, how):
    """Ranges of up to all rows, upward ones too, that begin inside or outside the table."""
    k = F.col("o_orderkey")
    asked = read(s, d, "orders").select("o_orderkey", "o_custkey")
    height = F.when(k % 23 == 0, 0).when(k % 3 == 0, -(k % 40)).otherwise(k * 7 % 2500 + 1)
    out = O.offset_range(asked, _offset_table(s, d), "o_orderkey", F.col("o_custkey"), F.lit(1), F.lit(-10), k % 2, height, k % 3 + 1, how)
    return out.select("o_orderkey", F.round("offset", 6).alias("offset"), "offset_err")


def _offset_range_sql(how):
    return f"""
    WITH t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_size::DOUBLE AS a, floor(p_retailprice)::DOUBLE AS c FROM part),
    v AS (SELECT r, 1 AS c, a AS x FROM t UNION ALL SELECT r, 3, c FROM t),
    h AS (SELECT o_orderkey, o_custkey - 10 AS r, 1 + o_orderkey % 2 AS c1, o_orderkey % 3 + 1 AS w,
                 CASE WHEN o_orderkey % 23 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN -(o_orderkey % 40) ELSE o_orderkey * 7 % 2500 + 1 END AS h FROM orders),
    q AS (SELECT *, CASE WHEN h < 0 THEN r + h + 1 ELSE r END AS r1, abs(h) AS n FROM h),
    g AS (SELECT o_orderkey, {how} AS x FROM q JOIN v ON v.r BETWEEN q.r1 AND q.r1 + q.n - 1 AND v.c BETWEEN c1 AND c1 + w - 1 WHERE r1 >= 1 AND h <> 0 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN h <> 0 AND r1 >= 1 THEN round(coalesce(g.x, 0), 6)::DOUBLE END AS "offset", CASE WHEN h = 0 OR r1 < 1 THEN '#REF!' END AS offset_err
    FROM q LEFT JOIN g USING (o_orderkey)"""


def _chart(s, d):
    rows = with_row_id(read(s, d, "orders"), ["o_orderkey"]).select(
        "_row_id", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("o_custkey").cast("double")).alias("cust"),
    )
    return R.chart_series(rows)


def _json_safe(s, d):
    rows = read(s, d, "lineitem").select(
        *LINE_KEY, F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(float("inf")))
        .when(F.col("l_linenumber") == 5, F.lit(float("-inf"))).otherwise(F.col("l_quantity")).alias("q"),
    )
    return json_safe(rows)


def _events_rounded(s, d):
    return read(s, d, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("u"), F.floor(F.col("value") / 10).alias("v"))


_EVENTS_SQL = "(SELECT event_id, event_type, user_id % 20 AS u, floor(value / 10)::BIGINT AS v FROM events)"


def _gappy_lines(s, d):
    n = F.col("l_linenumber")
    return read(s, d, "lineitem").select(
        *LINE_KEY, F.when(n % 2 == 0, F.col("l_quantity")).alias("a"), F.when(n % 3 == 0, F.col("l_tax")).alias("b"),
        F.when(n != 5, F.col("l_returnflag")).alias("c"), F.when(n > 2, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("d"),
    )


_GAPPY_SQL = f"""(SELECT {_LINE_KEY_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS b,
    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS c, CASE WHEN l_linenumber <= 2 THEN l_discount END AS d FROM lineitem)"""
_RATIO_SQL = "((CASE WHEN a IS NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NULL THEN 1 ELSE 0 END) + (CASE WHEN c IS NULL THEN 1 ELSE 0 END) + (CASE WHEN d IS NULL THEN 1 ELSE 0 END))"


def _missing_ratio(s, d):
    df = _gappy_lines(s, d)
    return df.select(*LINE_KEY, F.round(N.missing_ratio(df, ["a", "b", "c", "d"]), 6).alias("missing_ratio"))


def _noise(s, d, mode):
    df = _gappy_lines(s, d)
    out = N.noise_columns(df, ["a", "b", "c", "d"], mode=mode)
    return out.select(*LINE_KEY, "_is_noise_candidate", "_noise_reason", "_proposed_action", "_applied_action")


def _noise_sql(mode):
    action = "keep_after_auto_drop" if mode == "auto" else "keep"
    where = "WHERE NOT _is_noise_candidate" if mode == "auto" else ""
    return f"""
        WITH m AS (SELECT *, count(*) OVER (PARTITION BY a, b, c, d) > 1 AS dup, {_RATIO_SQL} / 5.0 >= 0.5 AS bare FROM {_GAPPY_SQL})
        SELECT * FROM (SELECT {_LINE_KEY_SQL}, dup OR bare AS _is_noise_candidate,
               CASE WHEN dup THEN 'duplicate_row' WHEN bare THEN 'high_missing_rate' ELSE '' END AS _noise_reason,
               CASE WHEN dup OR bare THEN 'drop_row' ELSE 'keep' END AS _proposed_action, '{action}' AS _applied_action FROM m) {where}"""


def _noise_counts(s, d, mode):
    return N.noise_metrics(N.noise_columns(_gappy_lines(s, d), ["a", "b", "c", "d"]), mode)


def _customers(s, d):
    return read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey") + F.col("c_custkey") % 3).alias("k"))


_CUSTOMERS_SQL = "(SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey + c_custkey % 3 END AS k FROM customer)"


def _vlookup(s, d):
    nations = read(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("k"), "n_name", "n_regionkey")
    return L.vlookup(_customers(s, d), "k", nations, 2, ["k"], "name")


def _vlookup_first(s, d):
    """Many parts per brand: the first one by key wins."""
    brands = read(s, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40).alias("brand"))
    return L.vlookup(brands, "brand", read(s, d, "part").select("p_brand", "p_partkey", "p_name"), 3, ["p_partkey"], "part")


def _vlookup_errors(s, d):
    base, nations = read(s, d, "supplier").select("s_suppkey", "s_nationkey"), read(s, d, "nation")
    out = base
    for name, index, approximate in (("over", 9, False), ("low", 0, False), ("half", 1.5, False), ("approx", 2, True)):
        out = L.vlookup(out, "s_nationkey", nations, index, ["n_nationkey"], name, approximate)
    return out.select("s_suppkey", "over_err", "low_err", "half_err", "approx_err")


def _xlookup(s, d):
    nations = read(s, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") != 4, F.col("n_name")))
    return L.xlookup(_customers(s, d), "k", nations, "n_nationkey", "n_name", ["n_nationkey"], "none", "name")


def _xlookup_na(s, d):
    return L.xlookup(_customers(s, d), "k", read(s, d, "nation"), "n_nationkey", "n_name", ["n_nationkey"], None, "name")


def _match(s, d):
    table = _numbered_part(s, d)
    brands = read(s, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40).alias("brand"))
    return L.match_position(brands, "brand", table, "p_brand")


def _index(s, d):
    table = _numbered_part(s, d).select("_row_id", "p_name", "p_brand", "p_size")
    asked = read(s, d, "orders").select("o_orderkey", "o_custkey")
    row = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 0.5).otherwise(F.col("o_custkey") - 5)
    return L.index_at(asked, table, row, F.col("o_orderkey") % 5)


_INDEX_SQL = """
    WITH t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part)
    SELECT o.o_orderkey, o.o_custkey,
           CASE WHEN o_orderkey % 11 <> 0 AND t.r IS NOT NULL THEN CASE o_orderkey % 5 WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_size END END AS "index",
           CASE WHEN o_orderkey % 11 = 0 THEN '#VALUE!' WHEN t.r IS NULL OR o_orderkey % 5 NOT BETWEEN 1 AND 3 THEN '#REF!' END AS index_err
    FROM orders o LEFT JOIN t ON o.o_custkey - 5 = t.r"""


def _predict_lookup(s, d):
    stored = read(s, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("prediction"))
    stored = with_row_id(stored, ["l_linenumber", "l_returnflag"])
    asked = read(s, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 9).cast("double").alias("l_linenumber"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("Q")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("l_returnflag")
    )
    return L.predict_lookup(asked, ["l_linenumber", "l_returnflag"], stored, "prediction").select("o_orderkey", "predict", "predict_err")


_PREDICT_SQL = """
    WITH s AS (SELECT l_linenumber, l_returnflag, sum(l_quantity)::BIGINT AS prediction FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, s.prediction AS predict, CASE WHEN s.prediction IS NULL THEN '#PREDICT_ERR' END AS predict_err
    FROM orders LEFT JOIN s ON o_orderkey % 9 = s.l_linenumber AND ['A', 'N', 'Q'][(o_orderkey % 3 + 1)::INT] = s.l_returnflag"""


def _attach(s, d):
    source = with_row_id(read(s, d, "supplier"), ["s_suppkey"])
    result = source.filter(F.col("s_suppkey") % 3 != 0).select("_row_id", F.when(F.col("s_suppkey") % 5 != 0, F.lit("hit")).alias("_predicted_class"))
    return R.attach_result(source.select("_row_id", "s_suppkey"), result, {"_predicted_class": "none", "_review_priority": 0})


def _to_numeric(s, d):
    raw = read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.col("source")).alias("raw"))
    return raw.select("doc_id", to_numeric(F.col("raw")).alias("value"))


def _view(s, d):
    return R.view(read(s, d, "customer"), F.col("c_mktsegment") == "BUILDING", [F.col("c_acctbal").desc(), "c_custkey"])


def _remove(s, d):
    return R.remove_columns(R.add_column(read(s, d, "nation"), "note"), ["n_regionkey"])


def _row_id_lines(s, d):
    return with_row_id(read(s, d, "lineitem"), LINE_KEY).select("_row_id", *LINE_KEY)


QUERIES = {
    "with_row_id": (_row_id_lines, f"SELECT row_number() OVER (ORDER BY {_LINE_KEY_SQL}) AS _row_id, {_LINE_KEY_SQL} FROM lineitem"),
    "preview": (
        lambda s, d: R.preview(_day(read(s, d, "orders"), "o_orderdate").drop("o_totalprice"), ["o_orderkey"]),
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 10",
    ),
    "page": (
        _orders_page,
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority, CAST(r AS VARCHAR) AS _row_id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN 41 AND 140",
    ),
    "apply_edits": (_apply_edits, _EDITS_SQL),
    "apply_edits_ordered": (_apply_ordered, _ORDERED_SQL),
    "hlookup": (_hlookup, _HLOOKUP_SQL),
    "offset_cell": (_offset, _OFFSET_SQL),
    "offset_sum": (lambda s, d: _offset_range(s, d, "sum"), _offset_range_sql("sum(x)")),
    "offset_max": (lambda s, d: _offset_range(s, d, "max"), _offset_range_sql("max(x)")),
    "offset_average": (lambda s, d: _offset_range(s, d, "average"), _offset_range_sql("avg(x)")),
    "json_rows": (
        lambda s, d: json_rows(read(s, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type", F.round("value", 2).alias("value"))).alias("body")), "body", "user_id long, event_type string, value double, absent string"),
        "SELECT event_id, user_id, event_type, round(value, 2) AS value, NULL::VARCHAR AS absent FROM events",
    ),
    "low_importance": (
        lambda s, d: R.low_importance(read(s, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg(F.col("p_size") / 50).alias("score")), 0.5, ["Brand#11"]).select("feature", F.round("score", 9).alias("score")),
        "SELECT p_brand AS feature, round(avg(p_size / 50.0::DOUBLE), 9) AS score FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1 HAVING avg(p_size / 50.0::DOUBLE) <= 0.5",
    ),
    "chart_series": (
        _chart,
        "SELECT r AS row, o_totalprice AS x, o_custkey::DOUBLE AS y FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE o_orderkey % 7 <> 0 AND o_custkey % 5 <> 0",
    ),
    "sort_filter_view": (_view, "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "add_remove_column": (_remove, "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation"),
    "json_safe": (_json_safe, f"SELECT {_LINE_KEY_SQL}, CASE WHEN l_linenumber NOT IN (3, 4, 5) THEN l_quantity END AS q FROM lineitem"),
    "to_numeric": (_to_numeric, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END AS value FROM documents"),
    "attach_result": (
        _attach,
        "SELECT row_number() OVER (ORDER BY s_suppkey) AS _row_id, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'hit' ELSE 'none' END AS _predicted_class, 0 AS _review_priority FROM supplier",
    ),
    "duplicate_rows": (
        lambda s, d: N.duplicate_rows(_events_rounded(s, d), ["event_type", "u", "v"]),
        f"SELECT *, count(*) OVER (PARTITION BY event_type, u, v) > 1 AS _is_duplicate FROM {_EVENTS_SQL}",
    ),
    "duplicate_documents": (
        lambda s, d: N.duplicate_rows(read(s, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "_is_duplicate"),
        "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS _is_duplicate FROM documents",
    ),
    "missing_ratio_row": (_missing_ratio, f"SELECT {_LINE_KEY_SQL}, round({_RATIO_SQL} / 5.0::DOUBLE, 6) AS missing_ratio FROM {_GAPPY_SQL}"),
    "noise_rows_preview": (lambda s, d: _noise(s, d, "preview"), _noise_sql("preview")),
    "noise_rows_auto": (lambda s, d: _noise(s, d, "auto"), _noise_sql("auto")),
    "noise_metrics": (
        lambda s, d: _noise_counts(s, d, "auto"),
        f"SELECT count(*) FILTER (_is_noise_candidate) AS noise_candidate_count, count(*) FILTER (NOT _is_noise_candidate) AS retained_count, 'auto' AS apply_mode FROM ({_noise_sql('preview')})",
    ),
    "vlookup": (
        _vlookup,
        f"SELECT c_custkey, c.k, n_name AS name, CASE WHEN n_name IS NULL THEN '#N/A' END AS name_err FROM {_CUSTOMERS_SQL} c LEFT JOIN nation ON c.k = n_nationkey",
    ),
    "vlookup_first_match": (
        _vlookup_first,
        """SELECT s_suppkey, 'Brand#' || s_suppkey % 40 AS brand, p.v AS part, CASE WHEN p.b IS NULL THEN '#N/A' END AS part_err
           FROM supplier LEFT JOIN (SELECT p_brand AS b, arg_min(p_name, p_partkey) AS v FROM part GROUP BY 1) p ON 'Brand#' || s_suppkey % 40 = p.b""",
    ),
    "vlookup_errors": (
        _vlookup_errors,
        "SELECT s_suppkey, '#REF!' AS over_err, '#VALUE!' AS low_err, '#VALUE!' AS half_err, '#UNSUPPORTED' AS approx_err FROM supplier",
    ),
    "xlookup": (
        _xlookup,
        f"""SELECT c_custkey, c.k, CASE WHEN n_nationkey IS NULL THEN 'none' WHEN n_nationkey <> 4 THEN n_name END AS name,
            CASE WHEN n_nationkey = 4 THEN '#REF!' END AS name_err FROM {_CUSTOMERS_SQL} c LEFT JOIN nation ON c.k = n_nationkey""",
    ),
    "xlookup_default_error": (
        _xlookup_na,
        f"SELECT c_custkey, c.k, n_name AS name, CASE WHEN n_nationkey IS NULL THEN '#N/A' END AS name_err FROM {_CUSTOMERS_SQL} c LEFT JOIN nation ON c.k = n_nationkey",
    ),
    "match_position": (
        _match,
        """WITH t AS (SELECT p_brand, min(r) AS m FROM (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) AS r FROM part) GROUP BY 1)
           SELECT s_suppkey, 'Brand#' || s_suppkey % 40 AS brand, t.m AS "match", CASE WHEN t.m IS NULL THEN '#N/A' END AS match_err
           FROM supplier LEFT JOIN t ON 'Brand#' || s_suppkey % 40 = t.p_brand""",
    ),
    "index_at": (_index, _INDEX_SQL),
    "predict_lookup": (_predict_lookup, _PREDICT_SQL),
    "number_text": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", canon_str(F.col("o_totalprice") * 64).alias("large"), canon_str(F.lit(2e15) + F.col("o_orderkey") * 8).alias("huge")),
        """SELECT o_orderkey, CASE WHEN floor(o_totalprice * 64) = o_totalprice * 64 THEN (o_totalprice * 64)::BIGINT::VARCHAR ELSE (o_totalprice * 64)::VARCHAR END AS large,
           (2000000000000000 + o_orderkey * 8)::BIGINT::VARCHAR AS huge FROM orders""",
    ),
    "canon_str": (
        lambda s, d: read(s, d, "lineitem").select(*LINE_KEY, canon_str(F.col("l_quantity")).alias("text")),
        f"SELECT {_LINE_KEY_SQL}, CAST(l_quantity::BIGINT AS VARCHAR) AS text FROM lineitem",
    ),
}
