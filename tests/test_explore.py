"""Composed Explore flow, boundary snapshot and row number / split / quantile internals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import lineage as G
from tablescope.operators import ordering as O
from tablescope.operators.rows import page, preview
from tablescope.plans import explore as X
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles
from tablescope.plans.surface import boundary_snapshot

FAST = {"trees": 5, "max_depth": 3, "rounds": 3}


def test_explore_small_table(spark):
    rows = [(i, float(i), i % 2, "A" if i < 4 else "B") for i in range(1, 7)]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 long, target string")
    out = X.explore(df, Roles(("f1", "f2"), "target", "id"), order_by=["id"], **FAST)
    assert out.sweep.count() == 4
    verdict = out.evaluation.first()
    assert verdict["overall_verdict"] == "not_enough_data" and "not_enough_rows" in verdict["risk_flags"]
    assert out.target["baseline_accuracy"] == 0.5


def test_explore_missing_label_and_risky_columns(spark):
    df = spark.createDataFrame([(float(i) if i == 0 else None, i % 2, "A" if i % 2 else "B") for i in range(5)], "f1 double, f2 long, target string")
    none = X.explore(df, Roles(("f1", "f2"), "nope"), order_by=["f2"]).evaluation.first()
    assert none["overall_verdict"] == "needs_better_target" and none["decision"]["recommended_path"] == "change_target"
    assert none["next_actions"][0]["action"] == "change_target"
    items = X.explore(df, Roles(("f1", "f2"), "target"), order_by=["f2", "target"], algorithms=["random_forest"], **FAST).evaluation.first()
    risky = [a for a in items["next_actions"] if a["action"] == "exclude_risky_columns"]
    assert risky and risky[0]["affected_columns"] == ["f1"]


def test_failing_model_is_a_row(spark):
    df = spark.createDataFrame([(i, float(i), "x") for i in range(30)], "id long, a double, y string")
    out = X.explore(df, Roles(("a",), "y", "id"), task="regression", order_by=["id"])
    assert {r["status"] for r in out.sweep.collect()} == {"failed"}
    assert out.evaluation.first()["overall_verdict"] == "needs_better_target"


def test_boundary_snapshot(spark):
    rows = [(i, float(i), float(i % 3), "A" if i < 5 else "B") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, target string")
    out = boundary_snapshot(df, Roles(("f1", "f2"), "target", "id"), PrepSpec(), "logistic_regression", resolution=10, order_by=["id"])
    assert out.points.count() == 10 and out.grid.count() == 100 and out.class_labels == ["A", "B"]
    facts = {r["statistic"]: r["value"] for r in out.statistics.collect()}
    assert facts["grid_point_count"] == 100 and 0 < facts["explained_variance_ratio_1"] <= 1
    with pytest.raises(ValueError, match="two axes"):
        boundary_snapshot(df, Roles(("f1",), "target"), order_by=["id"])
    with pytest.raises(ValueError, match="numeric"):
        boundary_snapshot(df, Roles(("f1", "f2"), "f1"), order_by=["id"])


def test_clustering_snapshot(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 4)]))]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double")
    roles = Roles(("f1", "f2"), id="id")
    result = W.find_clusters(df, roles, cluster_count=2, order_by=["id"]).rows
    out = boundary_snapshot(df, roles, result=result, kind="clustering", resolution=5, order_by=["id"])
    assert out.grid.count() == 25 and out.class_labels == ["cluster_0", "cluster_1"]
    assert out.points.filter("confidence < 0 or confidence > 1").count() == 0


@pytest.mark.parametrize("one_pass", [10**9, 1])
def test_quantiles(spark, monkeypatch, one_pass):
    monkeypatch.setattr(O, "ONE_PASS_VALUES", one_pass)
    monkeypatch.setattr(O, "_FETCH_VALUES", 50)
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.normal(0, 1, 900), np.full(700, 0.25), rng.exponential(100, 200)])
    df = spark.createDataFrame([(float(v), float(round(v, 1)), None) for v in a], "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = O.exact_quantiles(df, ["a", "b", "c"], probs)
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.quantile(np.round(a, 1), probs))
    assert got["c"] == [None] * len(probs)


def test_number_rows_and_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.col("id"))
    got = O.number_rows(df, [F.col("v").desc(), "id"]).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in got] == list(range(1, 1001))
    assert [r["v"] for r in got] == sorted((r["v"] for r in got), reverse=True)
    assert O.number_rows(df.limit(0), ["v"]).count() == 0
    rows = O.with_row_id(df, ["id"])
    assert [r["_row_id"] for r in page(rows, 1, 1).collect()] == ["2"]
    with pytest.raises(ValueError):
        page(rows, 0, 1001)
    assert preview(df, ["id"], 3).count() == 3


def test_long_chain_and_cycle(spark):
    """A running total over 3,000 rows plus a cycle that feeds a cell."""
    edges = [(f"S!A{i}", f"S!A{i - 1}") for i in range(2, 3001)] + [("S!X1", "S!Y1"), ("S!Y1", "S!X1"), ("S!Z1", "S!X1"), ("S!Z1", "S!A3000")]
    e = spark.createDataFrame(edges, "cell string, depends_on string")
    formulas = spark.createDataFrame([(f"S!A{i}",) for i in range(1, 3001)] + [("S!X1",), ("S!Y1",), ("S!Z1",)], "cell string")
    levels = {r["cell"]: r["level"] for r in G.recalc_levels(e, formulas).collect()}
    assert levels["S!A1"] == 0 and levels["S!A3000"] == 2999 and levels["S!X1"] is None and levels["S!Z1"] is None
    hit = {r["cell"] for r in G.affected_cells(e, spark.createDataFrame([("S!A2990",)], "cell string")).collect()}
    assert hit == {f"S!A{i}" for i in range(2990, 3001)} | {"S!Z1"}
    loop = {r["cell"] for r in G.affected_cells(e, spark.createDataFrame([("S!Y1",)], "cell string")).collect()}
    assert loop == {"S!X1", "S!Y1", "S!Z1"}


def test_golden_dependencies(spark):
    rows = [("S", f"{c}1", None, "1") for c in "ABC"] + [("S", "D1", "=SUM(A1:C1)", None), ("Sheet2", "B1", None, "2"), ("S", "E1", "=A1+Sheet2!B1", None)]
    e = G.formula_dependencies(spark.createDataFrame(rows, "sheet string, address string, formula string, value string"))
    got = {}
    for r in e.collect():
        got.setdefault(r["cell"], set()).add(r["depends_on"])
    assert got == {"S!D1": {"S!A1", "S!B1", "S!C1"}, "S!E1": {"S!A1", "Sheet2!B1"}}
