"""Golden values of the spreadsheet functions."""

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tablescope.functions import dates as D
from tablescope.functions import numeric as N
from tablescope.functions import text as X
from tablescope.functions import values as V
from tablescope.functions import volatile as R


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


L = F.lit
def null():
    return F.lit(None).cast("string")


def test_text_values(spark):
    got = one(
        spark,
        left=X.left(L("hello"), L(2)), right=X.right(L("hello"), L(2)), mid=X.mid(L("hello"), L(2), L(3)),
        left1=X.left(L("hello")), right0=X.right(L("hello"), L(0)),
        trim=X.trim_(L("  a   b  ")), concat=X.concat_(L("a"), L(1), null(), L("b")), concat_f=X.concat_(L(1.0), L(2.5), L(True)),
        sub=X.substitute(L("a-b-c"), L("-"), L("/")), sub0=X.substitute(L("abc"), L(""), L("-")),
        up=X.upper_(L("ab")), low=X.lower_(null()), len=X.len_(L("hello")), len0=X.len_(null()),
    )
    assert got == {
        "left": "he", "right": "lo", "mid": "ell", "left1": "h", "right0": "", "trim": "a b", "concat": "a1b",
        "concat_f": "12.5true", "sub": "a/b/c", "sub0": "a-b-c", "up": "AB", "low": "", "len": 5, "len0": 0,
    }


def test_text_errors(spark):
    got = one(
        spark,
        left=X.left(L("hello"), L(-1)), left_err=X.left_err(L("hello"), L(-1)), half=X.left_err(L("a"), L(1.5)),
        right_err=X.right_err(L("hello"), L(-1)), mid_err=X.mid_err(L("hello"), L(0), L(2)), ok=X.mid_err(L("hello"), L(1), L(2)),
    )
    assert got == {"left": None, "left_err": "#VALUE!", "half": "#VALUE!", "right_err": "#VALUE!", "mid_err": "#VALUE!", "ok": None}


def test_dates(spark):
    base = D.datevalue(L("2026-01-15"))
    got = one(
        spark,
        y=D.year_(D.date_(L(2026), L(5), L(12))), m=D.month_(D.date_(L(2026), L(5), L(12))), d=D.day_(D.date_(L(2026), L(5), L(12))),
        roll=D.date_(L(2026), L(14), L(0)), bad=D.datevalue_err(L("05/12/2026")),
        edate=D.month_(D.edate(base, L(2))), over=D.edate(L("2026-01-31"), L(1)), eom=D.day_(D.eomonth(base, L(0))),
        net=D.networkdays(L("2026-05-11"), L("2026-05-15")), rev=D.networkdays(L("2026-05-15"), L("2026-05-11")),
        neterr=D.networkdays_err(L("bad"), L("2026-05-15")),
        t0=D.text_(L(1.234), "0"), t2=D.text_(L(1.234), "0.00"), td=D.text_(L("2026-05-12"), "yyyy-mm-dd"),
        terr=D.text_err(L("2026-05-12"), "mmm"), tneg=D.text_(L(-1.5), "0"), tblank=D.text_(L(""), "0"), tbad=D.text_err(L("x"), "0"),
    )
    epoch = dt.date(1899, 12, 30)
    assert (got["y"], got["m"], got["d"]) == (2026, 5, 12)
    assert got["roll"] == (dt.date(2027, 1, 31) - epoch).days
    assert got["bad"] == "#VALUE!" and got["edate"] == 3 and got["eom"] == 31
    assert got["over"] == (dt.date(2026, 3, 3) - epoch).days
    assert got["net"] == 5 and got["rev"] == -5 and got["neterr"] == "#VALUE!"
    assert (got["t0"], got["t2"], got["td"], got["terr"]) == ("1", "1.23", "2026-05-12", "#UNSUPPORTED")
    assert (got["tneg"], got["tblank"], got["tbad"]) == ("-1", "0", "#VALUE!")


def test_networkdays_matches_counting(spark):
    rng = random.Random(3)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(900)), dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(900))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a date, b date").withColumn("n", D.networkdays(F.col("a"), F.col("b")))
    for r in df.collect():
        lo, hi = sorted((r.a, r.b))
        want = sum((lo + dt.timedelta(i)).weekday() < 5 for i in range((hi - lo).days + 1))
        assert r.n == (want if r.a <= r.b else -want)


def test_volatile(spark):
    got = one(
        spark,
        a=R.randbetween(L(1), L(3), draw=L(0.0)), b=R.randbetween(L(1), L(3), draw=L(0.99)), e=R.randbetween_err(L(3), L(1)),
        r=R.rand_(1), today=D.today(), now=D.now(),
    )
    assert (got["a"], got["b"], got["e"]) == (1.0, 3.0, "#VALUE!") and 0 <= got["r"] < 1
    assert got["today"] == (dt.datetime.now(dt.timezone.utc).date() - dt.date(1899, 12, 30)).days
    assert got["today"] <= got["now"] < got["today"] + 1.01


def test_numbers(spark):
    got = one(
        spark,
        s=N.sum_(L(1), L("2"), null(), L("x")), avg=N.average(L(3), null(), L("x")), mn=N.min_(L(3), null()), mx=N.max_(L(-3), L("t")),
        cnt=N.count_(L(3), null(), L(""), L("t")), inf=N.divide(L(1), L(0)), ninf=N.divide(L(-1), L(0)), nan=N.divide(L(0), L(0)),
        i=N.if_(L("no"), L(1), L(2)), i0=N.if_(L(""), L(1), L(2)), inul=N.if_(L(0), L(1)), a=N.and_(L(1), L("x")), o=N.or_(L(0), null()), n=N.not_(L(0.0)),
        r1=N.round_(L(1.005), 2), r2=N.round_(L(2.5)), r3=N.round_(L(-2.5)), r4=N.round_(L(1.45), 1), ab=N.abs_(L("-3")),
        d=N.plus(L("1d"), L(1)), le=N.less_equal(L(1), L(1)),
    )
    nan = got.pop("nan")
    assert math.isnan(nan)
    assert got == {
        "s": 3.0, "avg": 1.0, "mn": 0.0, "mx": 0.0, "cnt": 2, "inf": math.inf, "ninf": -math.inf, "i": 1, "i0": 2, "inul": None,
        "a": True, "o": False, "n": True, "r1": 1.0, "r2": 3.0, "r3": -3.0, "r4": 1.4, "ab": 3.0, "d": 1.0, "le": True,
    }


def test_round_is_exact(spark):
    rng = random.Random(5)
    xs = [round(rng.uniform(-1000, 1000), 3) for _ in range(2000)] + [k + 0.005 for k in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("r", N.round_(F.col("x"), 2))
    for r in df.collect():
        assert r.r == float(Decimal(r.x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)), r


def test_to_numeric_and_canon(spark):
    rows = [("1",), (" 2.5 ",), ("1d",), ("x",), (None,), ("1e3",), ("inf",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.v for r in df.select(V.to_numeric(F.col("s")).alias("v")).collect()]
    assert got == [1.0, 2.5, None, None, None, 1000.0, math.inf]
    assert one(spark, a=V.canon_str(L(7.0)), b=V.canon_str(L(7)), c=V.canon_str(L("7")), d=V.canon_str(L(0.5))) == {
        "a": "7", "b": "7", "c": "7", "d": "0.5"}


def test_row_key_and_json_safe(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("nan"), "a"), (None, "a"), (float("inf"), None)], "x double, s string")
    keys = [r.k for r in df.select(V.row_key(df, ["x", "s"]).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and len(set(keys)) == 3
    assert [r.x for r in V.json_safe(df).collect()] == [1.0, 1.0, None, None, None]


@pytest.mark.parametrize("a,b", [(1, 2), ("x", 0)])
def test_comparisons(spark, a, b):
    x, y = (a if isinstance(a, int) else 0), b
    got = one(spark, lt=N.less(L(a), L(b)), gt=N.greater(L(a), L(b)), ge=N.greater_equal(L(a), L(b)), eq=N.equal(L(a), L(b)), ne=N.not_equal(L(a), L(b)))
    assert got == {"lt": x < y, "gt": x > y, "ge": x >= y, "eq": x == y, "ne": x != y}


def test_number_text_has_plain_digits(spark):
    from tablescope.functions.dates import text_
    from tablescope.functions.numeric import round_
    from tablescope.functions.values import canon_str
    from tablescope.operators.lineage import column_label

    want = {12345678.9: "12345678.9", 0.0001: "0.0001", 2e15: "2000000000000000", -1.5e-7: "-1.5e-7", 1e21: "1e+21", 1.25e20: "125000000000000000000",
            -0.00012: "-0.00012", 1e-7: "1e-7", 0.000001: "0.000001", 5.0: "5", 0.5: "0.5", -12345678.25: "-12345678.25", 123456789012345680.0: "123456789012345680"}
    rows = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r.x: r.s for r in rows.select("x", canon_str(F.col("x")).alias("s")).collect()} == want
    big = spark.createDataFrame([(1e16,)], "x double").select(text_(F.col("x"), "0"), text_(F.col("x"), "0.00"), round_(F.lit(1.0000000000005), 12)).first()
    assert tuple(big) == ("10000000000000000", "10000000000000000.00", 1.000000000001)
    labels = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (18277,), (18278,), (475253,), (475254,)], "i int").select(column_label(F.col("i"))).collect()
    assert [r[0] for r in labels] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "ZZZZ", "AAAAA"]
