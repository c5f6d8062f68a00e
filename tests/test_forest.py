"""Trees grown on counts of binned rows, compared with Spark ML on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tablescope.operators import forest as T
from tablescope.operators import models as K
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles


@pytest.fixture(scope="module")
def rows(spark):
    """Two features with 23 and 11 values; a class with noise and a number with noise, as ``_y``."""
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.integers(0, 23, n) / 4, rng.integers(0, 11, n) * 1.5
    c = ((a * b > 18) ^ (rng.random(n) < 0.1)).astype(float)
    y = np.sin(a) * b + rng.normal(0, 1, n)
    table = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, v double")
    return table.select(array_to_vector(F.array("a", "b")).alias("features"), "c", "v").cache()


def said(model, rows, column="prediction"):
    return np.array([np.asarray(r[0]) for r in model.transform(rows).select(column).collect()])


@pytest.mark.parametrize("classification", [True, False])
def test_boosting_on_cells_is_boosting_on_rows(rows, classification):
    data = rows.withColumn("_y", F.col("c" if classification else "v"))
    estimator = (GBTClassifier if classification else GBTRegressor)(maxIter=12, maxDepth=3, stepSize=0.1, featuresCol="features", labelCol="_y")
    model, scorer = K._fit_cells(estimator, data, 2 if classification else 0, None)
    want = estimator.fit(data)
    column = "probability" if classification else "prediction"
    assert np.abs(said(model, data, column) - said(want, data, column)).max() < 1e-9
    assert np.abs(model.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-9
    assert model.getNumTrees == want.getNumTrees and list(model.treeWeights) == list(want.treeWeights)


@pytest.mark.parametrize("classification", [True, False])
def test_one_tree_on_cells_is_the_tree_on_rows(rows, classification):
    data = rows.withColumn("y", F.col("c" if classification else "v")).withColumn("weight", F.lit(1.0))
    bins = T.fit_bins(data, 2, 32)
    kind = T._Gini(2) if classification else T._Variance()
    t = T.celled(data, bins).toPandas()
    cells, place = np.unique(t["cell"], return_inverse=True)
    y = t["y"].to_numpy()
    parts = [y == 0, y == 1] if classification else [np.ones(len(y)), y, y * y]
    stats = np.stack([np.bincount(place, p.astype(float)) for p in parts], -1)
    nodes, leaf = T.grow(bins.bins(cells), bins.sizes, stats, kind, 6, 2, np.random.default_rng(0))
    want = (DecisionTreeClassifier if classification else DecisionTreeRegressor)(maxDepth=6, maxBins=32, labelCol="y").fit(data)
    assert np.abs(kind.prediction(np.array([n["stats"] for n in nodes]))[leaf][place] - said(want, data)).max() < 1e-9


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forest_needs_no_copy_of_the_rows_per_tree(spark, rows, monkeypatch, task):
    """The fit works without Spark ML's forest, which keeps a hundred counts for each row, and scores alike."""
    for kind in (RandomForestClassifier, RandomForestRegressor):
        monkeypatch.setattr(kind, "fit", lambda *a: pytest.fail("rows went to the forest one by one"))
    data = rows.select(vector_to_array("features").alias("x"), F.when(F.col("c") > 0, "hi").otherwise("lo").alias("c"), "v", F.monotonically_increasing_id().alias("id"))
    data = data.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "c", "v")
    label = "c" if task == "classification" else "v"
    out = W.fit_supervised(data, Roles(("a", "b"), label, "id"), PrepSpec(), "random_forest", task, ["id"], trees=30)
    got = {r["metric"]: r["value"] for r in out.metrics.collect()}
    assert got["test_accuracy"] > 0.85 if label == "c" else got["test_r2"] > 0.75
    new = data.withColumn("a", F.col("a") * 1.37 - 1)  # also cells no row was in
    fast = out.model.transform(new).drop("id").toPandas()
    out.model.scorer = None
    slow = out.model.transform(new).drop("id").toPandas()
    last = fast.columns[-1]
    assert np.abs(fast[last] - slow[last]).max() < 1e-12 and (label == "v" or (fast["_predicted_class"] == slow["_predicted_class"]).all())


def test_draws_of_a_numeric_target_are_a_bootstrap_of_the_rows(spark, monkeypatch):
    """Root of each tree: number, sum and squares of n rows drawn with replacement, also for a cell dealt to several tasks."""
    monkeypatch.setattr(T, "_DRAW_ROWS", 300)
    data = spark.range(2000).select(
        array_to_vector(F.array((F.col("id") % 2).cast("double"))).alias("features"), (F.col("id") % 701 / 100.0).alias("y"), F.lit(1.0).alias("weight"))
    bins = T.fit_bins(data, 1, 8)
    trees = T._forest_by_sum(data, bins, 200, 1, 42).filter("nodeData.id = 0").select("nodeData.impurityStats").collect()
    stats = np.array([r[0] for r in trees])
    y = np.array([r["y"] for r in data.select("y").collect()])
    assert len(stats) == 200
    for j, power in enumerate((0, 1, 2)):
        mean, spread = (y ** power).sum(), np.sqrt((y ** (2 * power)).sum())
        assert abs(stats[:, j].mean() - mean) < 5 * spread / np.sqrt(200) and 0.8 < stats[:, j].std() / spread < 1.25
    again = T._forest_by_sum(data.repartition(3), bins, 200, 1, 42).filter("nodeData.id = 0").select("nodeData.impurityStats").collect()
    assert np.allclose(np.sort([r[0][1] for r in again]), np.sort(stats[:, 1]))


def test_many_cells_go_to_spark_ml(rows, monkeypatch):
    assert T.bins_for(rows, 2, 32) is not None
    monkeypatch.setattr(T, "MAX_CELLS", 50)
    assert T.bins_for(rows, 2, 32) is None
