"""Ordered edits, lookups along a row, offset ranges, CHOOSE and DATEDIF against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablescope.functions import reference as E
from tablescope.operators import lookup as L
from tablescope.operators import ranges as O
from tablescope.operators import rows as R


def replay(rows, log):
    """Edits one by one."""
    now = {k: [a, b] for k, a, b in rows}
    for _, k, op, column, value in sorted(log, key=lambda e: e[0]):
        if op == "delete":
            now.pop(k, None)
        elif op == "insert":
            now.setdefault(k, [None, None])
        elif k in now:
            now[k]["ab".index(column)] = None if op == "clear" else value if column == "a" else int(value) if value.isdigit() else None
    return {k: tuple(v) for k, v in now.items()}


def test_edits_in_order_match_a_replay(spark):
    rng = random.Random(3)
    rows = [(k, f"t{k}", k) for k in range(40)]
    log = []
    for seq in rng.sample(range(2000), 900):
        op, column = rng.choice(["set", "set", "clear", "delete", "insert"]), rng.choice("ab")
        log.append((seq, rng.randrange(-5, 50) if seq % 3 else 7, op, column if op in ("set", "clear") else None, rng.choice(["1", "22", "x"]) if op == "set" else None))
    edits = spark.createDataFrame(log, "seq int, _row_id int, op string, column string, value string").repartition(5)
    got = R.apply_edits(spark.createDataFrame(rows, "_row_id int, a string, b int"), edits, sequence="seq")
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == replay(rows, log)
    assert R.apply_edits(spark.createDataFrame(rows, "_row_id int, a string, b int"), edits.limit(0), sequence="seq").count() == 40


def test_hlookup(spark):
    table = spark.createDataFrame([(1, "a", 2.0, "a", None), (2, "x", 5.0, "never", "n"), (3, None, 7.5, "never", "m")], "_row_id int, p string, q double, r string, s string")
    asked = spark.createDataFrame([("a", "2"), ("2", "3"), ("a", "3"), ("", "2.9"), ("zz", "2"), ("a", "4"), ("a", "0"), ("a", "w"), (None, "1")], "k string, r string")
    numbered = asked.coalesce(1).withColumn("i", F.monotonically_increasing_id())
    got = [(r.hlookup, r.hlookup_err) for r in L.hlookup(numbered, "k", table, F.col("r")).orderBy("i").collect()]
    assert got == [("x", None), ("7.5", None), (None, None), ("n", None), (None, "#N/A"), (None, "#REF!"), (None, "#VALUE!"), (None, "#VALUE!"), (None, None)]
    assert L.hlookup(asked, "k", table, 2, approximate=True).first()["hlookup_err"] == "#UNSUPPORTED"
    assert L.hlookup(asked.limit(1), "k", table.limit(0), 2).first()["hlookup_err"] == "#N/A"
    second = L.hlookup(asked.limit(1).withColumn("k", F.lit("never")), "k", table, 2, lookup_row=2).first()
    assert second["hlookup"] == "never"


@pytest.mark.parametrize("how", O.SUMMARIES)
def test_offset_range_matches_plain_sums(spark, how):
    rng = random.Random(6)
    cells = [[rng.choice([None, rng.randrange(-9, 9) * 1.0]), rng.choice(["t", "4", None])] for _ in range(2100)]
    table = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(cells)], "_row_id long, a double, b string")
    asks = [(i, rng.randrange(-3, 2200), rng.randrange(0, 4), rng.randrange(-40, 40), rng.choice([-3000, -7, 0, 1, 5, 40, 1500, 9000]), rng.choice([-2, 0, 1, 2, 9])) for i in range(200)]
    df = spark.createDataFrame(asks, "k int, r int, c int, dr int, h int, w int")
    got = O.offset_range(df, table, "k", F.col("r"), F.col("c"), F.col("dr"), F.lit("0"), F.col("h"), F.col("w"), how)
    found = {r.k: (r.offset, r.offset_err) for r in got.collect()}
    for k, r, c, dr, h, w in asks:
        r0, c0 = r + dr, c
        r1, c1 = (r0 + h + 1 if h < 0 else r0), (c0 + w + 1 if w < 0 else c0)
        if not h or not w or r1 < 1 or c1 < 1:
            assert found[k] == (None, "#REF!")
            continue
        values = [float(v) for row in cells[r1 - 1:r1 - 1 + abs(h)] for v in row[c1 - 1:c1 - 1 + abs(w)] if v is not None and v != "t"]
        want = {"sum": sum(values), "count": len(values), "min": min(values, default=0), "max": max(values, default=0), "average": sum(values) / len(values) if values else 0}[how]
        assert found[k][1] is None and found[k][0] == pytest.approx(want), (k, r, c, dr, h, w)
    bad = O.offset_range(df.limit(1), table, "k", F.lit("x"), F.col("c"), F.lit(0), F.lit(0), F.lit(1), F.lit(1), how).first()
    assert (bad["offset"], bad["offset_err"]) == (None, "#VALUE!")
    nothing = O.offset_range(df.limit(1), table.limit(0), "k", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(1), F.lit(1), how).first()
    assert (nothing["offset"], nothing["offset_err"]) == (0.0, None)


def test_choose(spark):
    df = spark.createDataFrame([("1",), ("2.9",), ("0",), ("4",), ("x",), (None,)], "i string")
    values = [F.lit("a"), F.lit("b"), F.lit(None).cast("string")]
    got = [tuple(r) for r in df.select(E.choose(F.col("i"), *values), E.choose_err(F.col("i"), *values)).collect()]
    assert got == [("a", None), ("b", None)] + [(None, "#VALUE!")] * 4


def test_datedif(spark):
    def one(a, b, unit):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return tuple(df.select(E.datedif(F.col("a"), F.col("b"), unit), E.datedif_err(F.col("a"), F.col("b"), unit)).first())

    assert one("2020-01-31", "2021-03-01", "M") == (13, None) and one("2020-01-31", "2021-03-01", "Y") == (1, None)
    assert one("2020-01-31", "2021-03-01", "ym") == (1, None) and one("2024-02-29", "2025-02-28", "Y") == (0, None)
    assert one("2001-06-01", "2002-08-15", "D") == (440, None) and one("2001-06-01", "2002-08-15", "YD") == (75, None) and one("2001-06-01", "2002-08-15", "MD") == (14, None)
    assert one("2020-05-20", "2021-03-10", "MD") == (18, None)
    for bad in [("2021-01-02", "2021-01-01", "D"), ("05/12/2026", "2026-06-01", "D"), ("2020-01-01", "2020-02-01", "W")]:
        assert one(*bad) == (None, "#VALUE!")
    day = datetime.date(2026, 5, 12)
    assert spark.range(1).select(E.datedif(F.lit(46154), F.lit(day), "D")).first()[0] == 0  # a serial number is a date too
