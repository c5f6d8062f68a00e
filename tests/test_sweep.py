"""The model sweep of Explore fits trees and kernels without a copy of the rows inside Spark ML."""

import pytest
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.sql import functions as F

from tablescope.plans import explore as X
from tablescope.plans.roles import Roles


def test_sweep_does_not_hand_rows_to_spark_mls_trees_and_kernels(spark, monkeypatch):
    for kind in (RandomForestClassifier, GBTClassifier, LinearSVC):
        monkeypatch.setattr(kind, "fit", lambda *a: pytest.fail("rows handed over"))
    rows = spark.range(300).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 10).alias("b"))
    rows = rows.withColumn("y", F.when(F.col("a") * F.col("b") > 20, "hi").otherwise("lo"))
    items = X.model_sweep(rows, Roles(("a", "b"), "y", "id"), "classification", order_by=["id"])
    assert [i["algorithm"] for i in items] == list(X.SWEEP["classification"])
    assert all(i["status"] == "success" and i["primary_metric"] > 0.7 for i in items)


@pytest.mark.parametrize("algorithm", ["gradient_boosting", "svm"])
def test_three_classes_are_fitted_without_spark_mls_copies(spark, monkeypatch, algorithm):
    from pyspark.ml.functions import array_to_vector

    from tablescope.operators import models as K

    for kind in (GBTClassifier, LinearSVC):
        monkeypatch.setattr(kind, "fit", lambda *a: pytest.fail("rows handed over"))
    rows = spark.range(200).select(
        array_to_vector(F.array(F.col("id") / 200, F.col("id") % 3 / 3)).alias("features"), F.when(F.col("id") < 60, "a").when(F.col("id") < 130, "b").otherwise("c").alias("y"))
    model = K.fit_vectors(rows, None, "y", algorithm, "classification", rounds=3)
    assert model.classes == ["a", "b", "c"]
    assert model.score_vectors(rows).filter(F.col("y") == F.col("_predicted_class")).count() > 180
