"""Permutation importance of linear models scored inside its buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import models as K
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles


@pytest.mark.parametrize("algorithm, task", [("logistic_regression", "two"), ("logistic_regression", "three"), ("linear_regression", "regression"), ("svm", "two")])
def test_scores_in_buckets_are_those_of_copied_rows(spark, monkeypatch, algorithm, task):
    rows = spark.range(900).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("b"))
    high = F.col("a") * 2 + F.col("b")
    y = (high + F.col("id") % 7 / 20) if task == "regression" else F.when(high > 1.8, "x").when(F.lit(task == "three") & (high > 1), "y").otherwise("z")
    kind = "regression" if task == "regression" else "classification"
    roles = Roles(("a", "b"), "t", "id")
    ready, pre, _ = W.split_and_fit_preprocessor(rows.withColumn("t", y), roles, PrepSpec(), kind, ["id"], {})
    model = K.fit_vectors(ready.filter("_split_role = 'train'"), pre, "t", algorithm, kind)
    monkeypatch.setattr(K, "EXCHANGE", 100)
    copies = K._exchanged(ready, "t", ["_row_id"], 2, 3, 42)
    want = {(r["_r"], r["_f"]): r["score"] for r in K._score(model, copies).collect()}
    got = K._scores_in_buckets(model, K._says(model), ready, ["_row_id"], 2, 3, 42)
    assert set(got) == set(want) and max(abs(got[c] - want[c]) for c in want) < 1e-9
    monkeypatch.setattr(K, "_exchanged", lambda *a: pytest.fail("rows were copied for each repeat and feature"))
    score = {r["feature"]: r["score"] for r in K.feature_importance(model, ready, pre.positions(), ["_row_id"], repeats=3).collect()}
    assert score["a"] > score["b"] > 0
    assert np.isclose(score["a"], np.mean([got[-1, -1] - got[r, 0] for r in range(3)]))
