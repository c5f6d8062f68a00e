"""Supervised fits, workflows and persistence on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import models as K
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles

FAST = {"trees": 10, "max_depth": 5, "rounds": 5}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 240
    a, b = rng.uniform(0, 10, n), rng.uniform(0, 5, n)
    cat = rng.choice(["x", "y", "z"], n)
    rows = [
        (i + 1, float(a[i]) if i % 17 else None, float(b[i]), str(cat[i]), "hi" if a[i] + b[i] > 8 else "mid" if a[i] > 4 else "lo", float(3 * a[i] - b[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y string, t double")


ROLES = Roles(features=("a", "b", "c"), label="y", id="id")


def values(metrics):
    return {r["metric"]: r["value"] for r in metrics.collect()}


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting", "svm", "logistic_regression"])
def test_classification(table, algorithm):
    out = W.fit_supervised(table, ROLES, PrepSpec(categorical_encoding="onehot"), algorithm, "classification", ["id"], **FAST)
    got = values(out.metrics)
    assert got["test_accuracy"] > 0.6 and got["train_count"] == 192 and got["test_count"] == 48
    assert 0 < got["confidence_mean"] <= 1
    rows = out.rows.toPandas()
    assert set(rows["_predicted_class"]) <= {"hi", "mid", "lo"}
    assert not rows.loc[rows["_split_role"] == "train", "_error_flag"].any()
    assert out.extra["confusion_matrix"].agg(F.sum("n")).first()[0] == 48


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting", "svm", "linear_regression", "auto"])
def test_regression(table, algorithm):
    out = W.fit_supervised(table, Roles(("a", "b"), "t", "id"), PrepSpec(), algorithm, "regression", ["id"], **FAST)
    assert values(out.metrics)["test_r2"] > 0.4
    assert out.rows.filter("_error_flag").count() >= 4


def test_regression_guard_and_messages(table):
    with pytest.raises(ValueError, match="numeric in every row"):
        W.fit_supervised(table, ROLES, task="regression", order_by=["id"])
    with pytest.raises(ValueError, match="not a column"):
        W.fit_supervised(table, Roles(("a",), "nope"), order_by=["id"])


def test_save_load_predict(table, tmp_path, spark):
    out = W.fit_supervised(table, ROLES, PrepSpec(), "logistic_regression", "classification", ["id"])
    K.save_model(out.model, str(tmp_path / "m"))
    back = K.load_model(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1.0, 1.0, "x"), (9.0, 4.0, "new")], "a double, b double, c string")
    got, want = K.predict(back, new).collect(), K.predict(out.model, new).collect()
    assert got == want and got[1]["_predicted_class"] == "hi"
    with pytest.raises(ValueError, match="missing"):
        K.predict(back, new.drop("b"))


def test_large_onehot_and_class_weight(table):
    wide = table.withColumn("c", F.concat(F.lit("v"), (F.col("id") % 90).cast("string")))
    out = W.fit_supervised(wide, ROLES, PrepSpec(categorical_encoding="onehot"), "logistic_regression", "classification", ["id"], class_weight="balanced")
    assert values(out.metrics)["test_accuracy"] > 0.5


def test_importance(table):
    out = W.fit_supervised(table, Roles(("a", "b"), "y", "id"), PrepSpec(), "logistic_regression", "classification", ["id"])
    ready, pre, _ = W.split_and_fit_preprocessor(table, Roles(("a", "b"), "y", "id"), PrepSpec(), "classification", ["id"], {})
    got = {r["feature"]: r["score"] for r in K.feature_importance(out.model, ready, pre.positions(), ["_row_id"], repeats=2).collect()}
    assert got["a"] > got["b"] >= 0


def test_exchanged_values_stay_in_their_column_and_bucket(spark, monkeypatch):
    """Each repeat is a permutation of every column, however the table is partitioned; one shuffle does all."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    monkeypatch.setattr(K, "EXCHANGE", 40)
    rows = spark.range(300).select("id", (F.col("id") % 5).alias("y"), array_to_vector(F.array(F.col("id") * 1.0, F.col("id") * 10.0)).alias("features"))
    seen = []
    for parts in (1, 7):
        mixed = K._exchanged(rows.repartition(parts), "y", ["id"], 2, 3, 42)
        got = mixed.select("_label", "_r", "_f", vector_to_array("features").alias("x")).toPandas()
        assert len(got) == 300 * (1 + 3 * 2)
        for (r, f), g in got.groupby(["_r", "_f"]):
            assert sorted(x[0] for x in g["x"]) == [float(i) for i in range(300)] and sorted(x[1] for x in g["x"]) == [10.0 * i for i in range(300)]
            kept = sum(x[1] == 10 * x[0] for x in g["x"])
            assert kept == (300 if r < 0 else 0)
        seen.append(sorted((r, f, y, *x) for y, r, f, x in zip(got["_label"], got["_r"], got["_f"], got["x"])))
    assert seen[0] == seen[1]
    assert mixed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_b") == 1
    one = K._exchanged(rows.limit(1), "y", ["id"], 2, 3, 42)
    assert one.count() == 7 and K._exchanged(rows.limit(0), "y", ["id"], 2, 3, 42).isEmpty()


def test_prepare(table):
    out = W.prepare(table, ROLES, PrepSpec(), order_by=["id"], **FAST)
    rows = out.rows.toPandas()
    assert rows["a"].between(0, 1).all() and rows["norm_a"].equals(rows["a"]) and len(rows) == 240
    need = {"_row_id", "_predicted_class", "_prediction_confidence", "_cluster_id", "_is_island", "_is_outlier", "_nearest_major_class",
            "_review_priority", "_nano_decision", "_nano_reason", "_nano_recommended_action"}
    assert need <= set(rows.columns) and rows["_review_priority"].between(30, 100).all()
    score = out.extra["feature_importance"].toPandas()
    assert list(score["feature"]) == ["a", "b", "c"] and abs(score["score"].sum() - 1) < 1e-6


def test_prepare_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, None, "k"), (3, None, "k")], "id long, f double, y string")
    rows = W.prepare(df, Roles(("f",), "y"), PrepSpec(), order_by=["id"]).rows.toPandas()
    assert (rows["f"] == 0).all() and (rows["_predicted_class"] == "k").all() and (rows["_prediction_confidence"] == 1.0).all()
    with pytest.raises(ValueError, match="nothing to prepare"):
        W.prepare(df, Roles(("none",), "y"), order_by=["id"])


@pytest.mark.parametrize("algorithm", ["isolation_forest", "one_class_svm", "local_outlier_factor"])
def test_anomalies(spark, algorithm):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), "no") for i, v in enumerate(rng.normal(0, 1, 95))] + [(100 + i, 30.0 + 5 * i, "anomaly") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v double, label string")
    out = W.detect_anomalies(df, Roles(("v",), "label", "id"), algorithm=algorithm, contamination=0.05, order_by=["id"])
    got = values(out.metrics)
    assert got["anomaly_count"] == 5 and got["recall"] >= 0.8
    top = out.rows.orderBy("_anomaly_rank").limit(2).toPandas()
    assert (top["_anomaly_reason"] == "score_above_threshold").all() and list(top["_anomaly_rank"]) == [1, 2]


@pytest.mark.parametrize("algorithm", ["kmeans", "dbscan"])
def test_clusters(spark, algorithm):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)]))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = W.find_clusters(df, Roles(("x", "y"), id="id"), algorithm=algorithm, cluster_count=3, eps=0.2, order_by=["id"])
    got = values(out.metrics)
    assert got["cluster_count"] == 3 and got["noise_count"] == 0 and got["silhouette_squared"] > 0.9
    assert out.rows.filter("_distance_to_centroid > 0.3").count() == 0


def test_noise(spark):
    rows = [(i, float(i % 50), "a" if i % 2 else None, None) for i in range(60)] + [(90, 5.0, "a", None), (91, None, None, None)]
    df = spark.createDataFrame(rows, "id long, v double, s string, e string")
    out = W.reduce_noise(df.drop("id").withColumn("_o", F.col("v")), Roles(("v",)), order_by=["v", "s"])
    assert out.rows.filter("_noise_reason = 'duplicate_row'").count() >= 2
    auto = W.reduce_noise(df, Roles(("v",), id="id"), mode="auto", order_by=["id"])
    facts = auto.metrics.first()
    assert facts["retained_count"] == auto.rows.count() == 62 - facts["noise_candidate_count"]
    assert auto.rows.filter("_applied_action != 'keep_after_auto_drop'").count() == 0


def test_recommendation_small(spark):
    df = spark.createDataFrame([("u1", "i1", 5), ("u1", "i2", 4), ("u2", "i1", 5), ("u3", "i3", 2)], "user string, item string, rating long")
    out = W.recommend_items(df, Roles(user="user", item="item", rating="rating"), 2)
    got = {(r["user"], r["_rank"]): r["recommended_item_id"] for r in out.rows.collect()}
    assert got == {("u1", 1): "i3", ("u2", 1): "i2", ("u2", 2): "i3", ("u3", 1): "i1", ("u3", 2): "i2"}
    assert values(out.metrics) == {"user_count": 3, "item_count": 3, "recommendation_count": 5, "coverage": 1.0, "top_k": 2}


@pytest.mark.parametrize("categories", [60, 70])
def test_importance_names_every_position(spark, categories):
    rows = spark.range(categories * 12).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(7)) * 1.0).alias("noise0"), F.concat(F.lit("k"), (F.col("id") % categories).cast("string")).alias("cat"),
        F.when(F.col("id") % categories == 3, "hi").otherwise("lo").alias("y"))
    spec = PrepSpec(categorical_encoding="onehot")
    out = W.fit_supervised(rows, Roles(("noise0", "cat"), "y", "id"), spec, "random_forest", "classification", ["id"])
    ready, pre, _ = W.split_and_fit_preprocessor(rows, Roles(("noise0", "cat"), "y", "id"), spec, "classification", ["id"], {})
    got = K.feature_importance(out.model, ready, pre.positions(), ["_row_id"]).collect()
    assert len(got) == categories + 1 and got[0]["feature"] == "cat_k3" and got[0]["score"] > 0.2
    from tablescope.operators.prepare import onehot, onehot_rows

    assert len(onehot(rows, ["cat"]).columns) == 3 + categories
    assert onehot_rows(rows, ["id"], "cat").agg(F.sum("value")).first()[0] == categories * 12


@pytest.mark.parametrize("normalization", ["standard", "minmax"])
def test_onehot_blocks_are_scaled_alike(spark, normalization):
    """60 and 70 categories: the same distances between rows, whether the block is stored dense or sparse."""
    from pyspark.ml.functions import vector_to_array

    from tablescope.operators.prepare import fit_preprocessor

    found = {}
    for categories in (60, 70):
        rows = spark.range(2100).select(
            "id", (F.col("id") % 13 * 1.0).alias("x"), F.concat(F.lit("v"), (F.pmod(F.xxhash64("id"), F.lit(categories * 3)) % categories).cast("string")).alias("c"))
        assert rows.select("c").distinct().count() == categories
        spec = PrepSpec(categorical_encoding="onehot", normalization=normalization)
        pre = fit_preprocessor(rows, ["x", "c"], spec, "prepare")
        assert bool(pre._wide_onehot()) == (categories == 70)
        data = pre.vector(rows).select("c", vector_to_array("features").alias("v")).toPandas()
        share = data["c"].value_counts() / len(data)
        m = np.array(data["v"].tolist())
        column = {n: i for i, n in enumerate(pre.positions())}
        for c in list(share.index)[:8]:
            jump = m[(data["c"] == c).to_numpy(), column[f"c_{c}"]].mean() - m[(data["c"] != c).to_numpy(), column[f"c_{c}"]].mean()
            want = 1.0 if normalization == "minmax" else 1 / np.sqrt(share[c] * (1 - share[c]))
            assert abs(jump - want) < 1e-9
        found[categories] = m.var(axis=0)[1:]
    if normalization == "standard":
        assert all(abs(v - 1).max() < 1e-9 for v in found.values())


@pytest.mark.parametrize("labels", [30, 1100])
def test_confusion_matrix_has_one_contract(spark, labels):
    from tablescope.operators.metrics import confusion_matrix

    scored = spark.range(labels).select(F.col("id").cast("string").alias("t"), F.lit("0").alias("p"))
    assert confusion_matrix(scored, "t", "p").agg(F.count("*"), F.sum("n")).first() == (labels * labels, labels)
    assert confusion_matrix(scored, "t", "p", dense=False).count() == labels


def test_silhouette_with_many_clusters(spark, monkeypatch):
    from tablescope.operators import metrics

    rows = spark.range(3000).select((F.col("id") % 100 * 10 + F.rand(3)).alias("x"), (F.col("id") % 100).alias("c"))
    whole = metrics.silhouette_squared(rows, ["x"], "c").first()[0]
    monkeypatch.setattr(metrics, "_CLUSTER_BLOCK", 30)
    assert abs(metrics.silhouette_squared(rows, ["x"], "c").first()[0] - whole) < 1e-9


def test_predict_batch_fits_on_all_lines(spark, sf, monkeypatch):
    from tablescope.catalog.models import QUERIES

    fit, fitted = W.fit_supervised, []

    def counted(df, *args, **params):
        fitted.append(df.count())
        return fit(df, *args, **params)

    monkeypatch.setattr(W, "fit_supervised", counted)
    scored = sum(r.n for r in QUERIES["predict_batch"][0](spark, sf).collect())
    assert fitted == [scored] == [spark.read.parquet(f"{sf}/lineitem.parquet").count()]
