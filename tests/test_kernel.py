"""Kernel models fitted without a table of cosine features, compared with Spark ML on such a table."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablescope.operators import kernel as V
from tablescope.operators import models as K
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 1, 1500), rng.uniform(0, 1, 1500)
    c = np.where((np.hypot(a - 0.5, b - 0.5) < 0.3) ^ (rng.random(1500) < 0.05), "in", "out")
    y = 40 + 9 * np.sin(6 * a) * b + rng.normal(0, 0.5, 1500) + np.where(rng.random(1500) < 0.02, 80, 0)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), str(c[i]), float(y[i])) for i in range(1500)], "id long, a double, b double, c string, v double").cache()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_loss_is_as_low_as_spark_mls(table, task):
    kernel = K.FourierMap(3.0, 2)
    rows = table.select(array_to_vector(F.array("a", "b")).alias("features"), (F.when(F.col("c") == "in", 1.0).otherwise(0.0) if task == "classification" else F.col("v")).alias("y"), F.lit(1.0).alias("weight"))
    estimator = (LinearSVC(maxIter=30, regParam=1 / 1500) if task == "classification" else LinearRegression(loss="huber", maxIter=50)).setLabelCol("y")
    z, y = kernel.of(np.array(table.select("a", "b").collect())), np.array([r["y"] for r in rows.select("y").collect()])

    def loss(model):
        m = z @ model.coefficients.toArray() + model.intercept
        if task == "classification":
            return np.maximum(0, 1 - (2 * y - 1) * m).mean() + 0.5 / 1500 * ((model.coefficients.toArray() * z.std(0, ddof=1)) ** 2).sum()
        away, s = np.abs(y - m), model.scale
        return np.where(away <= s * 1.35, s + away ** 2 / s, s + 2 * 1.35 * away - s * 1.35 ** 2).mean() / 2

    got, want = loss(V.fit(estimator, rows, kernel)), loss(estimator.fit(rows.withColumn("features", kernel.apply(F.col("features")))))
    assert got < want * 1.03


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_no_table_of_cosine_features_is_written(spark, table, monkeypatch, task):
    """The widest vector stored by a fit is that of the plain features, and Spark ML keeps no copy of its own."""
    for kind in (LinearSVC, LinearRegression):
        monkeypatch.setattr(kind, "fit", lambda *a: pytest.fail("the expanded table went to Spark ML, which keeps it"))
    monkeypatch.setattr(K, "materialize", lambda df: pytest.fail("the expanded table was written"))
    label = "c" if task == "classification" else "v"
    out = W.fit_supervised(table, Roles(("a", "b"), label, "id"), PrepSpec(), "svm", task, ["id"])
    got = {r["metric"]: r["value"] for r in out.metrics.collect()}
    assert got["test_accuracy"] > 0.85 if label == "c" else got["test_mae"] < 4
    # rows scored directly are those of the stored Spark ML model
    model, rows = out.model, out.model.pre.vector(table)
    wide = model.model.transform(rows.withColumn("features", model.kernel.apply(F.col("features"))))
    fast = [r[0] for r in model.transform(table).select("_predicted_class" if label == "c" else "_predicted_value").collect()]
    slow = [r[0] for r in wide.select("prediction").collect()]
    assert fast == [model.classes[int(p)] for p in slow] if label == "c" else np.allclose(fast, slow, atol=1e-9)
