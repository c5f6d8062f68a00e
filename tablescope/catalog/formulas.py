"""One query per spreadsheet function, over orders, lineitem and text tables."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.functions import dates as D
from tablescope.functions import numeric as N
from tablescope.functions import reference as E
from tablescope.functions import text as X
from tablescope.functions import volatile as V
from tablescope.operators import lineage as G

C, L = F.col, F.lit

# Order rows with blanks and text mixed in, and the same rows in SQL.


def _mixed(s, d):
    k = C("o_orderkey")
    return read(s, d, "orders").select(
        "o_orderkey",
        F.when(k % 4 != 0, C("o_totalprice")).alias("a"),
        F.when(k % 3 == 0, L("text")).when(k % 3 == 1, L("")).otherwise(C("o_custkey").cast("string")).alias("b"),
        (C("o_custkey") - 50).alias("c"),
        (k % 3 - 1).alias("z"),
    )


_MIXED_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS a,
    CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS b, o_custkey - 50 AS c, o_orderkey % 3 - 1 AS z FROM orders)"""
_A, _B, _Cn, _Z = "coalesce(a, 0.0)", "coalesce(TRY_CAST(b AS DOUBLE), 0.0)", "c::DOUBLE", "z::DOUBLE"


def _texts(s, d):
    """Whole document texts, some missing."""
    return read(s, d, "documents").select("doc_id", F.when(C("doc_id") % 7 != 0, C("text")).alias("t"), C("n_chars").alias("n"))


_TEXTS_SQL = "(SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS t, n_chars AS n FROM documents)"


def _dated(s, d):
    """Dates as ISO text, as serial number, or broken, plus a month shift."""
    k = C("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(s, d, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, L("05/12/2026")).otherwise(iso).alias("iso"),
        D.serial(C("o_orderdate").cast("date")).alias("num"), (k % 30 - 15).alias("m"),
        F.date_format(F.date_add(C("o_orderdate").cast("date"), (k % 41 - 20).cast("int")), "yyyy-MM-dd").alias("other"),
    )


_DATED_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '05/12/2026' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
    date_diff('day', DATE '1899-12-30', o_orderdate::DATE) AS num, o_orderkey % 30 - 15 AS m, o_orderdate::DATE AS day,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS good,
    o_orderdate::DATE + (o_orderkey % 41 - 20)::INT AS oday FROM orders)"""
_EPOCH = "DATE '1899-12-30'"


def _ser(expr):
    return f"date_diff('day', {_EPOCH}, ({expr})::DATE)"


def _numbers(name, value, sql):
    """Query over the mixed order rows with one result column."""
    return name, (
        lambda s, d: _mixed(s, d).select("o_orderkey", value().alias("result")),
        f"SELECT o_orderkey, {sql} AS result FROM {_MIXED_SQL}",
    )


def _text(name, value, sql, err=None, err_sql=None):
    cols = (lambda: [value().alias("result")]) if err is None else (lambda: [value().alias("result"), err().alias("error")])
    more = "" if err is None else f", {err_sql} AS error"
    return name, (lambda s, d: _texts(s, d).select("doc_id", *cols()), f"SELECT doc_id, {sql} AS result{more} FROM {_TEXTS_SQL}")


def _date(name, value, sql, err=None, err_sql=None):
    cols = (lambda: [value().alias("result")]) if err is None else (lambda: [value().alias("result"), err().alias("error")])
    more = "" if err is None else f", {err_sql} AS error"
    return name, (lambda s, d: _dated(s, d).select("o_orderkey", *cols()), f"SELECT o_orderkey, {sql} AS result{more} FROM {_DATED_SQL}")


def _divide(s, d):
    q = N.divide(C("a"), C("z"))
    text = F.when(F.isnan(q), L("NaN")).when(q == float("inf"), L("Infinity")).when(q == float("-inf"), L("-Infinity"))
    return _mixed(s, d).select("o_orderkey", F.coalesce(text, F.round(q, 6).cast("decimal(20,4)").cast("string")).alias("result"))


_DIVIDE_SQL = f"""SELECT o_orderkey, CASE WHEN z = 0 AND {_A} = 0 THEN 'NaN' WHEN z = 0 AND {_A} > 0 THEN 'Infinity' WHEN z = 0 THEN '-Infinity'
    ELSE CAST(CAST(round({_A} / z, 6) AS DECIMAL(20, 4)) AS VARCHAR) END AS result FROM {_MIXED_SQL}"""


def _compare(s, d):
    a, c = C("a"), C("c")
    return _mixed(s, d).select(
        "o_orderkey", N.less(a, c).alias("lt"), N.less_equal(C("z"), L(0)).alias("le"), N.greater(c, L(0)).alias("gt"),
        N.greater_equal(C("z"), L(0)).alias("ge"), N.equal(C("b"), C("z")).alias("eq"), N.not_equal(C("b"), C("z")).alias("ne"),
    )


_COMPARE_SQL = f"""SELECT o_orderkey, {_A} < c AS lt, z <= 0 AS le, c > 0 AS gt, z >= 0 AS ge, {_B} = z AS eq, {_B} <> z AS ne FROM {_MIXED_SQL}"""


def _ranges(s, d):
    """Column-range forms: one aggregate per function, grouped."""
    a, b, z = C("a"), C("b"), C("z")
    return _mixed(s, d).groupBy((C("o_orderkey") % 50).alias("g")).agg(
        F.round(N.sum_range(a), 2).alias("sum"), F.round(N.average_range(a), 4).alias("average"), N.min_range(a).alias("min"),
        N.max_range(b).alias("max"), N.count_range(b).alias("count"), N.and_range(z).alias("and"), N.or_range(b).alias("or"),
    )


_RANGES_SQL = f"""SELECT o_orderkey % 50 AS g, round(sum({_A}), 2) AS sum, round(avg({_A}), 4) AS average, min({_A}) AS min, max({_B}) AS max,
    count(*) FILTER (b <> '') AS count, bool_and(z <> 0) AS "and", bool_or(b <> '') AS "or" FROM {_MIXED_SQL} GROUP BY 1"""

# Exact decimal of the binary value is out of reach in SQL; the lost part of the product decides ties.
_ROUND_SQL = """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice * l_discount AS v FROM lineitem),
    p AS (SELECT *, v * 100.0::DOUBLE AS p, v * 134217729.0::DOUBLE AS w FROM x),
    h AS (SELECT *, w - (w - v) AS hi FROM p),
    e AS (SELECT *, (hi * 100.0::DOUBLE - p) + (v - hi) * 100.0::DOUBLE AS lost, floor(p) AS whole FROM h)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           (CASE WHEN ((p - whole) - 0.5::DOUBLE) + lost >= 0 THEN whole + 1 ELSE whole END) / 100.0::DOUBLE AS result FROM e"""


def _round(s, d):
    line = read(s, d, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", N.round_(C("l_extendedprice") * C("l_discount"), 2).alias("result")
    )


def _conversation_concat(s, d):
    return read(s, d, "conversations").select(
        "conv_id", "turn", X.concat_(C("role"), L(":"), C("turn"), L(None).cast("string"), C("turn") * L(1.0), C("text")).alias("result")
    )


def _randbetween(s, d):
    low = (C("o_orderkey") % 5 - 2).cast("double")
    high = (C("o_orderkey") % 7 - 2).cast("double")
    v = V.randbetween(low, high, seed=7)
    return read(s, d, "orders").select(
        (v.isNull() | ((v >= low) & (v <= high) & (v == F.floor(v)))).alias("in_range"), V.randbetween_err(low, high).alias("error")
    ).groupBy("in_range", "error").agg(F.count(L(1)).alias("n"))


def _volatile(s, d):
    return read(s, d, "orders").select(
        (D.now() >= D.today()).alias("now_after_today"), ((V.rand_(3) >= 0) & (V.rand_(4) < 1)).alias("in_unit"),
        (D.today() > 46000).alias("today_is_recent"),
    ).groupBy("now_after_today", "in_unit", "today_is_recent").agg(F.count(L(1)).alias("n"))


def _address(s, d):
    row, col = C("o_orderkey").cast("int"), (C("o_orderkey") * 7 % 18000).cast("int")
    made = read(s, d, "orders").select("o_orderkey", row.alias("row"), col.alias("col"), G.to_address(row, col).alias("address"))
    r, c = G.parse_address(C("address"))
    return made.select("o_orderkey", "address", r.alias("parsed_row"), c.alias("parsed_col"))


_ADDRESS_SQL = """
    WITH x AS (SELECT o_orderkey, (o_orderkey * 7 % 18000)::INT AS c FROM orders)
    SELECT o_orderkey, (CASE WHEN c < 26 THEN chr(65 + c) WHEN c < 702 THEN chr(65 + (c - 26) // 26) || chr(65 + (c - 26) % 26)
           ELSE chr(65 + (c - 702) // 676) || chr(65 + (c - 702) // 26 % 26) || chr(65 + (c - 702) % 26) END) || CAST(o_orderkey + 1 AS VARCHAR) AS address,
           o_orderkey::INT AS parsed_row, c AS parsed_col FROM x"""

_LEFT_N = "CASE WHEN doc_id % 6 = 5 THEN -1 ELSE doc_id % 6 END"


def _size():
    return F.when(C("doc_id") % 6 == 5, L(-1)).otherwise(C("doc_id") % 6)


_WEEKDAYS = """(SELECT CASE WHEN good <= oday THEN count(*) ELSE -count(*) END FROM range(0, abs(date_diff('day', good, oday)) + 1) r(i)
    WHERE isodow(least(good, oday) + i::INT) < 6)"""

_MONTHS = "((year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::INT)"
_DATEDIF = {
    "y": f"{_MONTHS} // 12", "m": _MONTHS, "d": "date_diff('day', a, b)", "ym": f"{_MONTHS} % 12",
    "md": "CASE WHEN day(b) >= day(a) THEN day(b) - day(a) ELSE date_diff('day', ((date_trunc('month', b) - INTERVAL 1 MONTH)::DATE + (day(a) - 1)::INT)::DATE, b) END",
    "yd": f"date_diff('day', make_date(year(a) + {_MONTHS} // 12, month(a), 1) + (day(a) - 1)::INT, b)",
}


def _datedif(s, d):
    """From ISO text, broken now and then, to a day up to four years before or after."""
    rows = _dated(s, d).select("o_orderkey", "iso", (C("num") + C("o_orderkey") % 2900 - 1400).alias("end"))
    return rows.select("o_orderkey", *[E.datedif(C("iso"), C("end"), u.upper()).alias(u) for u in _DATEDIF], E.datedif_err(C("iso"), C("end"), "Y").alias("error"))


_DATEDIF_SQL = f"""
    WITH x AS (SELECT o_orderkey, good AS a, (day + (o_orderkey % 2900 - 1400)::INT)::DATE AS b FROM {_DATED_SQL})
    SELECT o_orderkey, {", ".join(f"CASE WHEN b >= a THEN ({v})::BIGINT END AS {u}" for u, v in _DATEDIF.items())}, CASE WHEN b >= a THEN NULL ELSE '#VALUE!' END AS error FROM x"""


def _choose(s, d):
    k = C("o_orderkey")
    at = F.when(k % 7 == 0, L("x")).otherwise((k % 6 + 0.7).cast("string"))
    values = (C("o_orderstatus"), C("o_orderpriority"), L("third"), C("o_custkey").cast("string"))
    return read(s, d, "orders").select("o_orderkey", E.choose(at, *values).alias("result"), E.choose_err(at, *values).alias("error"))


_CHOOSE_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderkey % 6 WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority WHEN 3 THEN 'third' WHEN 4 THEN o_custkey::VARCHAR END END AS result,
           CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 6 NOT BETWEEN 1 AND 4 THEN '#VALUE!' END AS error FROM orders"""

QUERIES = dict([
    ("f_datedif", (_datedif, _DATEDIF_SQL)),
    ("f_choose", (_choose, _CHOOSE_SQL)),
    _numbers("f_plus", lambda: F.round(N.plus(C("a"), C("b")), 4), f"round({_A} + {_B}, 4)"),
    _numbers("f_minus", lambda: F.round(N.minus(C("a"), C("c")), 4), f"round({_A} - {_Cn}, 4)"),
    _numbers("f_times", lambda: F.round(N.times(C("b"), C("z")), 4) + 0.0, f"round({_B} * {_Z}, 4) + 0.0"),
    ("f_divide", (_divide, _DIVIDE_SQL)),
    ("f_compare", (_compare, _COMPARE_SQL)),
    _numbers("f_sum", lambda: F.round(N.sum_(C("a"), C("b"), C("c")), 4), f"round({_A} + {_B} + {_Cn}, 4)"),
    _numbers("f_average", lambda: F.round(N.average(C("a"), C("b"), C("c")), 4), f"round(({_A} + {_B} + {_Cn}) / 3.0, 4)"),
    _numbers("f_min", lambda: N.min_(C("a"), C("b"), C("c")), f"least({_A}, {_B}, {_Cn})"),
    _numbers("f_max", lambda: N.max_(C("a"), C("b"), C("c")), f"greatest({_A}, {_B}, {_Cn})"),
    _numbers("f_count", lambda: N.count_(C("a"), C("b"), C("c")), "(CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b = '' THEN 0 ELSE 1 END + 1)::BIGINT"),
    ("f_ranges", (_ranges, _RANGES_SQL)),
    _numbers("f_if", lambda: N.if_(C("z"), C("c"), L(-1)), "CASE WHEN z <> 0 THEN c ELSE -1 END"),
    _numbers("f_and", lambda: N.and_(C("a"), C("b"), C("z")), "coalesce(a, 0) <> 0 AND b <> '' AND z <> 0"),
    _numbers("f_or", lambda: N.or_(C("a"), C("b")), "coalesce(a, 0) <> 0 OR b <> ''"),
    _numbers("f_not", lambda: N.not_(C("a")), "NOT (coalesce(a, 0) <> 0)"),
    _numbers("f_abs", lambda: N.abs_(C("c")), f"abs({_Cn})"),
    ("f_round", (_round, _ROUND_SQL)),
    ("f_concat", (
        _conversation_concat,
        "SELECT conv_id, turn, concat(role, ':', turn, turn, text) AS result FROM conversations",
    )),
    _text("f_left", lambda: X.left(C("t"), _size()), f"CASE WHEN {_LEFT_N} >= 0 THEN left(coalesce(t, ''), {_LEFT_N}) END",
          lambda: X.left_err(C("t"), _size()), f"CASE WHEN {_LEFT_N} < 0 THEN '#VALUE!' END"),
    _text("f_right", lambda: X.right(C("t"), _size()), f"CASE WHEN {_LEFT_N} >= 0 THEN right(coalesce(t, ''), {_LEFT_N}) END",
          lambda: X.right_err(C("t"), _size()), f"CASE WHEN {_LEFT_N} < 0 THEN '#VALUE!' END"),
    _text("f_mid", lambda: X.mid(C("t"), C("doc_id") % 4, _size()),
          f"CASE WHEN doc_id % 4 >= 1 AND {_LEFT_N} >= 0 THEN substr(coalesce(t, ''), doc_id % 4, {_LEFT_N}) END",
          lambda: X.mid_err(C("t"), C("doc_id") % 4, _size()), f"CASE WHEN doc_id % 4 < 1 OR {_LEFT_N} < 0 THEN '#VALUE!' END"),
    _text("f_len", lambda: X.len_(C("t")), "length(coalesce(t, ''))"),
    _text("f_trim", lambda: X.trim_(C("t")), "trim(regexp_replace(coalesce(t, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"),
    _text("f_upper", lambda: X.upper_(C("t")), "upper(replace(coalesce(t, ''), 'ß', 'ss'))"),
    _text("f_lower", lambda: X.lower_(C("t")), "lower(coalesce(t, ''))"),
    _text("f_substitute", lambda: X.substitute(C("t"), L("e"), L("[E]")), "replace(coalesce(t, ''), 'e', '[E]')"),
    _date("f_date", lambda: D.date_(F.year(C("iso").try_cast("date")), C("m"), C("m") * 2),
          _ser("(make_date(year(good)::BIGINT, 1, 1) + to_months((m - 1)::INT))::DATE + (m * 2 - 1)::INT"),
          lambda: D.date_err(F.year(C("iso").try_cast("date")), C("m"), C("m") * 2), "CASE WHEN good IS NULL THEN '#VALUE!' END"),
    _date("f_datevalue", lambda: D.datevalue(C("iso")), _ser("good"), lambda: D.datevalue_err(C("iso")), "CASE WHEN good IS NULL THEN '#VALUE!' END"),
    _date("f_year", lambda: D.year_(C("num")), "year(day)"),
    _date("f_month", lambda: D.month_(C("iso")), "month(good)"),
    _date("f_day", lambda: D.day_(C("num")), "day(day)"),
    _date("f_edate", lambda: D.edate(C("num"), C("m")), _ser("date_trunc('month', day)::DATE + to_months(m::INT)") + " + day(day) - 1"),
    _date("f_eomonth", lambda: D.eomonth(C("iso"), C("m")), _ser("last_day(date_trunc('month', good)::DATE + to_months(m::INT))"),
          lambda: D.shift_err(C("iso"), C("m")), "CASE WHEN good IS NULL THEN '#VALUE!' END"),
    _date("f_networkdays", lambda: D.networkdays(C("iso"), C("other")),
          f"CASE WHEN good IS NOT NULL THEN {_WEEKDAYS} END", lambda: D.networkdays_err(C("iso"), C("other")), "CASE WHEN good IS NULL THEN '#VALUE!' END"),
    _date("f_text_date", lambda: D.text_(C("num"), "yyyy-mm-dd"), "strftime(day, '%Y-%m-%d')"),
    _date("f_text_unknown", lambda: D.text_(C("num"), "mmm"), "NULL::VARCHAR", lambda: D.text_err(C("num"), "mmm"), "'#UNSUPPORTED'"),
    _numbers("f_text_whole", lambda: D.text_(C("a"), "0"), "CAST(floor(coalesce(a, 0.0) + 0.5)::BIGINT AS VARCHAR)"),
    _numbers("f_text_cents", lambda: D.text_(C("a"), "0.00"), "printf('%.2f', coalesce(a, 0.0))"),
    ("f_randbetween", (_randbetween, None)),
    ("f_volatile", (_volatile, None)),
    ("f_address", (_address, _ADDRESS_SQL)),
])
