"""Feature signal against its definition on a small table."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.operators import signal as G

ROWS = [(i, "ab"[i % 2], float(i % 2) if i % 10 else None, i % 7 * 1.0, f"t{i}", "x", ("ab"[i % 2] if i % 6 else "c"), 3.0 * (i % 2) + i % 3 if i % 11 else None) for i in range(240)]
SCHEMA = "k long, y string, copy double, other double, ident string, same string, near string, z double"
COLS = ["copy", "other", "ident", "same", "near"]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def information(pairs):
    n, both = len(pairs), Counter(pairs)
    a, b = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    return sum(c / n * math.log(c * n / (a[x] * b[y])) for (x, y), c in both.items())


def scores(signal):
    return {(r.feature, r.score_kind): r.score for r in signal.collect()}


def test_mutual_information_matches_its_definition(table):
    got = scores(G.feature_signal(table, ["y", *COLS], "y", categories=3))
    at = {c: i for i, c in enumerate(SCHEMA.replace(",", "").split()[::2])}
    top = sorted(Counter(r[at["ident"]] for r in ROWS), key=lambda v: (-1, v))[:3]
    for c in COLS:
        values = [r[at[c]] if c != "ident" or r[at[c]] in top else "rest" for r in ROWS]
        assert got[c, G.MUTUAL] == pytest.approx(information(list(zip(values, (r[1] for r in ROWS)))), abs=1e-9)
    assert got["same", G.MUTUAL] == 0 and len(got) == len(COLS)


def test_regression_has_correlations_and_flags(table):
    signal = G.feature_signal(table, COLS, "z", "regression", importance=table.sparkSession.createDataFrame([("copy", 0.7)], "feature string, score double"))
    got = scores(signal)
    assert set(got) == {(c, G.MUTUAL) for c in COLS} | {("copy", G.CORRELATION), ("other", G.CORRELATION), ("copy", G.IMPORTANCE)}
    known = [(r[2], r[7]) for r in ROWS if r[2] is not None and r[7] is not None]
    mx, my = (sum(v[i] for v in known) / len(known) for i in (0, 1))
    top = sum((x - mx) * (y - my) for x, y in known)
    assert got["copy", G.CORRELATION] == pytest.approx(top / math.sqrt(sum((x - mx) ** 2 for x, _ in known) * sum((y - my) ** 2 for _, y in known)))
    flags = {r.feature: r.warning_flags for r in signal.collect()}
    assert flags["ident"] == ["likely_identifier"] and flags["same"] == ["low_variance"] and flags["copy"] == []
    advice = {r.feature: r.advice for r in G.strongest(signal, 2).collect()}
    assert advice["ident"] == advice["same"] == "exclude" and advice["copy"] == "use" and "y" not in advice


def test_joint_counts_are_bounded_and_keep_all_rows(table):
    joint = G.joint_counts(table, ["ident", "near"], "y", "classification", categories=5)
    assert joint.groupBy("feature").agg(F.sum("n").alias("n")).filter("n <> 240").count() == 0
    assert joint.filter("feature = 'ident'").count() <= 7 * 2
    other = table.withColumn("ident", F.lit("other"))  # a value that looks like the folded part
    assert G.joint_counts(other, ["ident"], "y", "classification").filter("NOT is_rest").count() == 2


def test_without_rows_or_target(spark, table):
    assert {r.score for r in G.feature_signal(table.limit(0), COLS, "y", "classification").collect()} == {0.0}
    empty = table.withColumn("y", F.lit(None).cast("string"))
    assert {r.score for r in G.feature_signal(empty, COLS, "y", "classification").collect()} == {0.0}
