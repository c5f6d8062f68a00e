"""Supervised models on Spark ML behind one fit / transform pair."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.values import canon_str, numeric_of
from tablescope.operators import forest as T
from tablescope.operators import kernel as V
from tablescope.operators.metrics import confidence_from_scores
from tablescope.operators.prepare import Dictionary, Preprocessor
from tablescope.plans.roles import PrepSpec
from tablescope.session import materialize, small  # noqa: F401  tests watch what is written here

# Algorithm names.
ALGORITHMS = ("random_forest", "gradient_boosting", "svm", "logistic_regression", "linear_regression")

#: Rows of a bucket within which permutation importance exchanges values.
EXCHANGE = 1024
TREES = 100
MAX_DEPTH = 10
ROUNDS = 100
_FOURIER = 64
# Classes fitted at once where a model knows two only.
_PARALLEL = 8
_TREE_LIKE = ("random_forest", "gradient_boosting")


def resolve_algorithm(name: str, classification: bool) -> str:
    """Unknown names mean random forest; the two linear models stand in for each other."""
    if name not in ALGORITHMS:
        return "random_forest"
    if name in ("logistic_regression", "linear_regression"):
        return "logistic_regression" if classification else "linear_regression"
    return name


def is_classification(df: DataFrame, label: str) -> bool:
    return df.schema[label].dataType.simpleString() in ("string",) or df.schema[label].dataType.typeName() in ("varchar", "char")


def build_estimator(algorithm: str, classification: bool, rows: int, classes: int = 2, weight: str | None = None, **params):
    """The Spark ML estimator for an algorithm name."""
    algorithm = resolve_algorithm(algorithm, classification)
    cols = {"featuresCol": "features", "labelCol": "_y"}
    if weight and algorithm in ("random_forest", "logistic_regression", "svm"):
        cols["weightCol"] = weight
    trees, depth = params.get("trees", TREES), params.get("max_depth", MAX_DEPTH)
    if algorithm == "random_forest":
        kind = RandomForestClassifier if classification else RandomForestRegressor
        return kind(numTrees=trees, maxDepth=depth, seed=42, maxBins=params.get("max_bins", 64), **cols)
    if algorithm == "gradient_boosting":
        rounds = {"maxIter": params.get("rounds", ROUNDS), "maxDepth": 3, "stepSize": 0.1, "seed": 42}
        if not classification:
            return GBTRegressor(**rounds, **cols)
        one = GBTClassifier(**rounds, **cols)
        return one if classes <= 2 else OneVsRest(classifier=one, parallelism=_PARALLEL, **cols)
    if algorithm == "svm":
        if not classification:
            return LinearRegression(loss="huber", maxIter=50, **{k: v for k, v in cols.items() if k != "weightCol"})
        one = LinearSVC(maxIter=30, regParam=1.0 / max(1, rows), **cols)
        return one if classes <= 2 else OneVsRest(classifier=one, parallelism=_PARALLEL, **cols)
    if algorithm == "logistic_regression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(1, rows), standardization=False, **cols)
    return LinearRegression(solver="auto", maxIter=100, **cols)


def class_weights(df: DataFrame, label: str, weights: str | dict[str, float], out: str = "_weight") -> DataFrame:
    """``balanced``: n / (classes * class size); or an explicit weight per class."""
    y = canon_str(F.col(f"`{label}`"))
    if weights == "balanced":
        counts = df.groupBy(y.alias("_class")).agg(F.count(F.lit(1)).alias("_k"))
        facts = counts.agg(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("c")).first()
        table = small(counts.select("_class", (F.lit(float(facts["n"])) / (F.lit(float(facts["c"])) * F.col("_k"))).alias(out)))
        return df.withColumn("_class", y).join(table, "_class", "left").drop("_class")
    value = F.lit(1.0)
    for name, w in weights.items():
        value = F.when(y == str(name), F.lit(float(w))).otherwise(value)
    return df.withColumn(out, value)


@dataclass
class FourierMap:
    """Random cosine features whose inner product approximates a Gaussian kernel."""

    gamma: float
    width: int
    size: int = _FOURIER
    seed: int = 42

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self._w = rng.normal(0.0, math.sqrt(2.0 * self.gamma), size=(self.size, self.width)).T
        self._b = rng.uniform(0.0, 2.0 * math.pi, size=self.size)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Features (rows x size) of the rows of a matrix."""
        return np.cos(x @ self._w + self._b) * math.sqrt(2.0 / self.size)

    def apply(self, v: Column) -> Column:
        kernel = self

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel.of(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        run.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return array_to_vector(F.pandas_udf(run, "array<double>")(vector_to_array(v)))


@dataclass
class FittedModel:
    """Preprocessor, optional kernel map and Spark ML model, applied in one lazy pass."""

    pre: Preprocessor
    model: Model | None
    algorithm: str
    task: str
    label: str | None
    classes: list[str] = field(default_factory=list)
    kernel: FourierMap | None = None
    #: Says what ``model`` says, once for all rows of a cell; only for trees grown on cells.
    scorer: T.Scorer | None = None

    @property
    def features(self) -> list[str]:
        return self.pre.features

    def score_vectors(self, df: DataFrame) -> DataFrame:
        """Scores rows that already carry the ``features`` vector."""
        if self.model is None:
            return df.withColumns({"_predicted_class": F.lit(self.classes[0] if self.classes else None), "_prediction_confidence": F.lit(1.0)})
        keep = list(df.columns)
        work = df
        direct = self.kernel is not None and isinstance(self.model, (LinearSVCModel, LinearRegressionModel))
        if self.kernel and not direct:
            work = df.withColumn("_plain", F.col("features")).withColumn("features", self.kernel.apply(F.col("features")))
        if self.scorer:
            said = self.scorer.column(vector_to_array("features"))
            if self.task == "regression":
                return df.withColumn("_predicted_value", F.get(said, F.lit(0))).select(*keep, "_predicted_value")
            scored = df.withColumn("probability", said).withColumn("prediction", F.array_position("probability", F.array_max("probability")) - 1)
        elif direct:
            said = V.margins(self.kernel, self.model, vector_to_array("features"))
            if self.task == "regression":
                return df.withColumn("_predicted_value", said).select(*keep, "_predicted_value")
            scored = df.withColumn("_margin", said).withColumns({"prediction": (F.col("_margin") > 0).cast("double"), "rawPrediction": F.array(-F.col("_margin"), F.col("_margin"))})
        else:
            scored = self.model.transform(work)
        if self.kernel and not direct:
            scored = scored.drop("features").withColumnRenamed("_plain", "features")
        if self.task == "regression":
            return scored.withColumn("_predicted_value", F.col("prediction")).select(*keep, "_predicted_value")
        names = F.array(*[F.lit(c) for c in self.classes])
        label = F.element_at(names, F.col("prediction").cast("int") + 1)
        if "probability" in scored.columns:
            confidence = confidence_from_scores(probability=F.col("probability") if self.scorer else vector_to_array("probability"))
        else:
            raw = F.col("rawPrediction") if direct else vector_to_array("rawPrediction")
            margins = F.slice(raw, 2, 1) if len(self.classes) <= 2 else raw
            confidence = confidence_from_scores(margins=margins)
        return scored.withColumns({"_predicted_class": label, "_prediction_confidence": confidence}).select(
            *keep, "_predicted_class", "_prediction_confidence"
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus prediction columns. Works on a streaming DataFrame as well."""
        return self.score_vectors(self.pre.vector(df)).drop("features")

    def importances(self) -> list[float] | None:
        if self.algorithm not in _TREE_LIKE or self.model is None:
            return None
        if isinstance(self.model, OneVsRestModel):
            parts = np.array([m.featureImportances.toArray() for m in self.model.models])
            return list(map(float, parts.mean(axis=0)))
        return list(map(float, self.model.featureImportances.toArray()))


def fit_vectors(
    train: DataFrame, pre: Preprocessor, label: str, algorithm: str, task: str,
    class_weight: str | dict[str, float] | None = None, **params,
) -> FittedModel:
    """Fit on rows that already carry the ``features`` vector."""
    classification = task == "classification"
    name = resolve_algorithm(algorithm, classification)
    classes: list[str] = []
    weight = None
    if classification:
        work = train.withColumn("_label", canon_str(F.col(f"`{label}`")))
        indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(work)
        classes = list(indexer.labels)
        if len(classes) <= 1:
            return FittedModel(pre, None, name, task, label, classes)
        work = indexer.transform(work)
        if class_weight is not None:
            work, weight = class_weights(work, label, class_weight), "_weight"
    else:
        work = train.withColumn("_y", numeric_of(train, label))
    columns = ["features", "_y", *([weight] if weight else [])]
    work = work.select(*columns)
    kernel = None
    if name == "svm":
        width = len(work.first()["features"])
        x = vector_to_array("features")
        each = work.agg(*[F.avg(x[i]).alias(f"a{i}") for i in range(width)], *[F.var_pop(x[i]).alias(f"v{i}") for i in range(width)]).first()
        spread = float(np.mean([each[f"v{i}"] for i in range(width)]) + np.var([each[f"a{i}"] for i in range(width)]))
        kernel = FourierMap(1.0 / (width * spread) if spread else 1.0, width)
    estimator = build_estimator(name, classification, work.count(), len(classes), weight, **params)
    model, scorer = _fit_cells(estimator, work, len(classes), weight) if name in _TREE_LIKE else (None, None)
    if kernel:
        rows = _plain(work, weight)
        if isinstance(estimator, OneVsRest):
            model = _each_class(estimator, rows, len(classes), lambda part: V.fit(estimator.getClassifier(), part, kernel))
        else:
            model = V.fit(estimator, rows, kernel)
    return FittedModel(pre, model or estimator.fit(work), name, task, label, classes, kernel, scorer)


def _fit_cells(estimator, work: DataFrame, classes: int, weight: str | None) -> tuple[Model | None, T.Scorer | None]:
    """The trees of ``estimator`` grown on counts of binned rows; nothing where those are no fewer than the rows."""
    if classes > T.MAX_CLASSES:
        return None, None
    first = work.first()
    if first is None:
        return None, None
    rows = _plain(work, weight)
    one = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    bins = T.bins_for(rows, len(first["features"]), one.getMaxBins())
    if bins is None:
        return None, None
    params = {"featuresCol": "features", "labelCol": "_y", "predictionCol": "prediction", "maxBins": one.getMaxBins()}
    if isinstance(estimator, OneVsRest):
        return _each_class(estimator, rows, classes, lambda part: T.boosted(part, bins, True, one.getMaxIter(), one.getMaxDepth(), one.getStepSize(), params)[0]), None
    if isinstance(estimator, (GBTClassifier, GBTRegressor)):
        return T.boosted(rows, bins, classes > 0, estimator.getMaxIter(), estimator.getMaxDepth(), estimator.getStepSize(), params)
    return T.forest(rows, bins, classes, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed(), params)


def _each_class(estimator: OneVsRest, rows: DataFrame, classes: int, fit: Callable[[DataFrame], Model]) -> OneVsRestModel:
    """A model for each class against the others."""
    models = [fit(rows.withColumn("y", (F.col("y") == k).cast("double"))) for k in range(classes)]
    return estimator._copyValues(OneVsRestModel(models=models))


def _plain(work: DataFrame, weight: str | None) -> DataFrame:
    return work.select("features", F.col("_y").cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))


def predict(model: FittedModel, df: DataFrame) -> DataFrame:
    """Batch prediction; all feature columns must be there."""
    absent = [c for c in model.features if c not in df.columns]
    if absent:
        raise ValueError(f"the table lacks feature columns the model was fitted with; missing: {absent}")
    return model.transform(df)


def save_model(model: FittedModel, path: str) -> None:
    """Spark ML model plus a JSON side table with preprocessing and roles."""
    spark = SparkSession.getActiveSession()
    pre = model.pre
    for i, c in enumerate(pre.categorical):
        if pre.codes[c].table is not None:
            pre.codes[c].table.write.mode("overwrite").parquet(os.path.join(path, f"dictionary_{i}"))
    meta = {
        "algorithm": model.algorithm, "task": model.task, "label": model.label, "classes": model.classes,
        "kernel": asdict(model.kernel) if model.kernel else None, "has_model": model.model is not None,
        "spec": asdict(pre.spec), "preset": pre.preset, "numeric": pre.numeric, "categorical": pre.categorical, "fills": pre.fills,
        "scales": pre.scales, "spreads": pre.spreads, "codes": {c: {"size": d.size, "values": d.values} for c, d in pre.codes.items()},
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "meta"))
    if model.model is not None:
        PipelineModel([model.model]).write().overwrite().save(os.path.join(path, "model"))


def load_model(spark: SparkSession, path: str) -> FittedModel:
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    codes = {}
    for i, c in enumerate(meta["categorical"]):
        d = meta["codes"].get(c)
        if d is None:
            continue
        table = None if d["values"] is not None else spark.read.parquet(os.path.join(path, f"dictionary_{i}"))
        codes[c] = Dictionary(d["size"], d["values"], table)
    pre = Preprocessor(
        PrepSpec(**meta["spec"]), meta["preset"], meta["numeric"], meta["categorical"], meta["fills"], codes,
        {c: tuple(s) for c, s in meta["scales"].items()}, meta.get("spreads", {}),
    )
    model = PipelineModel.load(os.path.join(path, "model")).stages[0] if meta["has_model"] else None
    kernel = FourierMap(**meta["kernel"]) if meta["kernel"] else None
    return FittedModel(pre, model, meta["algorithm"], meta["task"], meta["label"], meta["classes"], kernel)


def feature_importance(
    model: FittedModel, vectors: DataFrame, names: Sequence[str], key: Sequence[str], repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """(feature, score), highest first: tree importances, else the mean score lost when a feature is shuffled.

    ``names`` has one entry per position of the feature vector (``Preprocessor.positions``).

    Rows are dealt to buckets of about ``EXCHANGE`` by a hash of the key, so the result does not
    depend on how the table is partitioned. Within its bucket a row takes the values of one a hashed
    shift away, another shift in each repeat; all features and repeats are scored in one pass
    behind that one shuffle.
    """
    spark = vectors.sparkSession
    found = model.importances()
    if found is not None:
        if len(found) != len(names):
            raise ValueError(f"{len(names)} names for a vector of {len(found)} positions")
        return _ranked(spark, [(n, float(s)) for n, s in zip(names, found)])
    says = _says(model)
    if says is None:
        mixed = _exchanged(vectors, model.label, key, len(names), repeats, seed)
        scores = {(r["_r"], r["_f"]): r["score"] for r in _score(model, mixed).collect()}  # one row per feature and repeat
    else:
        scores = _scores_in_buckets(model, says, vectors, key, len(names), repeats, seed)
    plain = scores.get((-1, -1), 0.0)
    lost = [sum(plain - scores.get((r, f), plain) for r in range(repeats)) / repeats for f in range(len(names))]
    return _ranked(spark, [(n, max(0.0, float(x))) for n, x in zip(names, lost)])


def _dealt(vectors: DataFrame, label: Column, key: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Buckets of rows (label, x) in a hashed order, and a shift for each repeat."""
    buckets = max(1, -(-vectors.count() // EXCHANGE))
    keys = [F.col(f"`{c}`") for c in key]
    rows = vectors.select(
        F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets)).alias("_b"),
        F.struct(F.struct(F.xxhash64(F.lit(seed), *keys), *keys).alias("at"), label.alias("label"), vector_to_array("features").alias("x")).alias("row"))
    dealt = rows.groupBy("_b").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("_n", F.size("rows"))
    shifts = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.when(
        F.col("_n") > 1, F.pmod(F.xxhash64("_b", r, F.lit(seed)), F.col("_n") - 1) + 1).otherwise(0).cast("int"))
    return dealt.withColumn("_shifts", shifts)


def _says(model: FittedModel) -> Callable[[np.ndarray], np.ndarray] | None:
    """What a linear model says about a matrix of feature vectors, class numbers or values; nothing for other models."""
    kind, kernel = model.model, model.kernel
    if isinstance(kind, LogisticRegressionModel):
        coef, shift = kind.coefficientMatrix.toArray().T, kind.interceptVector.toArray()
        if coef.shape[1] == 1:
            return lambda x: (x @ coef[:, 0] + shift[0] > 0).astype(int)
        return lambda x: (x @ coef + shift).argmax(1)
    if isinstance(kind, (LinearSVCModel, LinearRegressionModel)):
        weights, start, classes = kind.coefficients.toArray(), kind.intercept, model.task == "classification"

        def says(x: np.ndarray) -> np.ndarray:
            m = (kernel.of(x) if kernel else x) @ weights + start
            return (m > 0).astype(int) if classes else m

        return says
    return None


def _scores_in_buckets(model: FittedModel, says: Callable, vectors: DataFrame, key: Sequence[str], width: int, repeats: int, seed: int) -> dict[tuple[int, int], float]:
    """Accuracy or R2 by (repeat, feature), (-1, -1) as it is: buckets are scored where they are, no copy of a row is made."""
    classes = model.task == "classification"
    label = F.col(f"`{model.label}`")
    at = F.array_position(F.array(*[F.lit(c) for c in model.classes]), canon_str(label)) - 1 if classes else label
    dealt = _dealt(vectors, at.cast("double"), key, repeats, seed)
    flat = dealt.select(F.transform("rows", lambda r: r["label"]).alias("y"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"), "_shifts")
    cells = [(-1, -1), *[(r, f) for r in range(repeats) for f in range(width)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(cells))
        for b in batches:
            for y, x, shifts in zip(b["y"], b["x"], b["_shifts"]):
                y, x = np.asarray(y, dtype=float), np.asarray(x, dtype=float).reshape(len(y), -1)
                for i, (r, f) in enumerate(cells):
                    mixed = x
                    if f >= 0:
                        mixed = x.copy()
                        mixed[:, f] = np.roll(x[:, f], -int(shifts[r]))
                    got = says(mixed)
                    total[i] += (got == y).sum() if classes else ((y - got) ** 2).sum()
        yield pd.DataFrame({"total": [total.tolist()]})

    sums = np.sum([r["total"] for r in flat.mapInPandas(run, "total array<double>").collect()], axis=0)  # one row per task
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), (F.lit(None) if classes else F.var_pop(label.cast("double"))).alias("v")).first()
    if not facts["n"] or not (classes or facts["v"]):
        return {}
    each = sums / facts["n"] if classes else 1.0 - sums / facts["n"] / facts["v"]
    return {c: float(v) for c, v in zip(cells, each)}


def _exchanged(vectors: DataFrame, label: str, key: Sequence[str], width: int, repeats: int, seed: int) -> DataFrame:
    """Every row once as it is (_r and _f are -1), and once per repeat and feature with that value exchanged."""
    dealt = _dealt(vectors, F.col(f"`{label}`"), key, repeats, seed)
    dealt = dealt.select(F.explode(F.transform("rows", lambda row, i: F.struct(
        row["label"].alias("_label"), row["x"].alias("x"),
        F.transform("_shifts", lambda s: F.get(F.col("rows"), F.pmod(i + s, F.col("_n")))["x"]).alias("others")))).alias("row")).select("row.*")
    cells = F.expr(f"transform(sequence(0, {repeats * width} - 1), c -> struct(cast(c div {width} AS int) AS _r, c % {width} AS _f))")
    spread = dealt.withColumn("cell", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("_r"), F.lit(-1).alias("_f"))), cells))).select("*", "cell.*")
    other = F.get("others", F.col("_r"))
    taken = F.when(F.col("_f") < 0, F.col("x")).otherwise(F.transform("x", lambda v, i: F.when(i == F.col("_f"), F.get(other, i)).otherwise(v)))
    return spread.select("_label", "_r", "_f", array_to_vector(taken).alias("features"))


def _ranked(spark: SparkSession, scores: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(sorted(scores, key=lambda x: (-x[1], x[0])), "feature string, score double")


def _score(model: FittedModel, rows: DataFrame) -> DataFrame:
    """Accuracy or R2 per repeat and feature."""
    scored = model.score_vectors(rows)
    if model.task == "classification":
        hit = (canon_str(F.col("_label")) == F.col("_predicted_class")).cast("double")
        return scored.groupBy("_r", "_f").agg(F.avg(hit).alias("score"))
    y, away = F.col("_label").cast("double"), F.col("_label").cast("double") - F.col("_predicted_value")
    return scored.groupBy("_r", "_f").agg((F.lit(1.0) - F.avg(away * away) / F.var_pop(y)).alias("score"))
