"""Scores of finished predictions; every function is one or two aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import canon_str, numeric_of
from tablescope.operators.ordering import exact_quantiles

# Texts read as a positive or a negative anomaly label.
POSITIVE_LABELS = ("1", "true", "yes", "anomaly", "outlier", "bad", "noise")
NEGATIVE_LABELS = ("0", "false", "no", "normal", "clean", "ok")

_LABEL_BLOCKS = 16
_CLUSTER_BLOCK = 10_000


def _long(wide: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return wide.select(F.inline(F.array(*cells)))


def class_counts(scored: DataFrame, truth: str, pred: str, split: str) -> DataFrame:
    """Per split and class: rows of that class, predicted as it, and both."""
    cells = scored.groupBy(
        F.col(split).alias("split"), canon_str(F.col(truth)).alias("t"), canon_str(F.col(pred)).alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    return cells.select("split", F.inline(sides)).groupBy("split", "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def class_metrics_by_split(scored: DataFrame, truth: str, pred: str, split: str = "_split_role") -> DataFrame:
    per_class = class_counts(scored, truth, pred, split)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("predicted"))
    weight = F.col("support")
    total = F.sum(weight)
    return per_class.groupBy("split").agg(
        (F.sum("hits") / total).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        (F.sum(weight * precision) / total).alias("precision"),
        (F.sum(weight * F.coalesce(recall, F.lit(0.0))) / total).alias("recall"),
        (F.sum(weight * f1) / total).alias("f1"),
        total.alias("rows"),
    )


def class_metrics(
    scored: DataFrame, truth: str, pred: str, split: str = "_split_role", confidence: str | None = None
) -> DataFrame:
    """(metric, value): test scores without prefix, then train_ and test_ scores, and row counts."""
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]
    by_split = class_metrics_by_split(scored, truth, pred, split)
    sides = {"": "test", "train_": "train", "test_": "test"}
    picks = {f"{p}{m}": F.max(F.when(F.col("split") == s, F.col(m))) for p, s in sides.items() for m in names}
    for s in ("train", "test", "unused"):
        picks[f"{s}_count"] = F.coalesce(F.max(F.when(F.col("split") == s, F.col("rows"))), F.lit(0))
    out = _long(by_split.agg(*[v.alias(k) for k, v in picks.items()]), list(picks))
    if confidence:
        means = scored.agg(
            F.coalesce(F.avg(F.when(F.col(split) == "test", F.col(confidence))), F.lit(0.0)).alias("confidence_mean"),
            F.coalesce(F.avg(F.when(F.col(split) == "train", F.col(confidence))), F.lit(0.0)).alias("train_confidence_mean"),
        )
        out = out.unionByName(_long(means, ["confidence_mean", "train_confidence_mean"]))
    return out


def confusion_matrix(scored: DataFrame, truth: str, pred: str, dense: bool = True) -> DataFrame:
    """(truth, prediction, n) over the union of labels.

    ``dense`` returns every pair of labels, zeros included: as many rows as labels squared,
    whatever their number. Otherwise only cells that occur.
    """
    cells = scored.groupBy(canon_str(F.col(truth)).alias("truth"), canon_str(F.col(pred)).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return cells
    labels = cells.select(F.explode(F.array("truth", "prediction")).alias("label")).distinct()
    # every label meets every block of labels, so no task holds all of them
    left = labels.select(F.col("label").alias("truth"), F.explode(F.sequence(F.lit(0), F.lit(_LABEL_BLOCKS - 1))).alias("_b"))
    right = labels.select(F.col("label").alias("prediction"), F.pmod(F.xxhash64("label"), F.lit(_LABEL_BLOCKS)).cast("int").alias("_b"))
    return left.join(right, "_b").join(cells, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def regression_metrics(scored: DataFrame, actual: str, predicted: str, split: str = "_split_role") -> DataFrame:
    y, away = F.col(actual), F.col(actual) - F.col(predicted)
    by_split = scored.groupBy(F.col(split).alias("split")).agg(
        F.avg(F.abs(away)).alias("mae"), F.sqrt(F.avg(away * away)).alias("rmse"),
        F.when(F.var_pop(y) > 0, F.lit(1.0) - F.avg(away * away) / F.var_pop(y))
        .otherwise(F.when(F.avg(away * away) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("r2"),
        F.avg(away).alias("residual_mean"), F.stddev_pop(away).alias("residual_std"), F.count(F.lit(1)).alias("rows"),
    )
    sides = {"": "test", "train_": "train", "test_": "test"}
    picks = {f"{p}{m}": F.max(F.when(F.col("split") == s, F.col(m))) for p, s in sides.items() for m in ("mae", "rmse", "r2")}
    for m in ("residual_mean", "residual_std"):
        picks[m] = F.coalesce(F.max(F.when(F.col("split") == "test", F.col(m))), F.lit(0.0))
    for s in ("train", "test", "unused"):
        picks[f"{s}_count"] = F.coalesce(F.max(F.when(F.col("split") == s, F.col("rows"))), F.lit(0))
    return _long(by_split.agg(*[v.alias(k) for k, v in picks.items()]), list(picks))


def classification_columns(scored: DataFrame, label: str, split: str = "_split_role") -> DataFrame:
    """_is_correct for all rows, _error_flag for wrong test rows."""
    correct = canon_str(F.col(f"`{label}`")) == canon_str(F.col("_predicted_class"))
    return scored.withColumns({"_is_correct": correct, "_error_flag": (F.col(split) == "test") & ~correct})


def error_flag(scored: DataFrame, error: str = "_absolute_error", split: str = "_split_role") -> DataFrame:
    """Flags test rows at or above the 90th percentile of the test error."""
    cut = exact_quantiles(scored.filter(F.col(split) == "test"), [error], [0.9])[error][0]
    if cut is None:
        return scored.withColumn("_error_flag", F.lit(False))
    return scored.withColumn("_error_flag", (F.col(split) == "test") & (F.col(error) >= F.lit(cut)))


def regression_columns(scored: DataFrame, label: str, split: str = "_split_role") -> DataFrame:
    out = scored.withColumn("_actual_value", numeric_of(scored, label))
    out = out.withColumn("_residual", F.col("_actual_value") - F.col("_predicted_value"))
    out = out.withColumns({"_absolute_error": F.abs("_residual"), "_prediction_confidence": F.lit(1.0)})
    return error_flag(out, "_absolute_error", split)


def confidence_from_scores(probability: Column | None = None, margins: Column | None = None) -> Column:
    """Largest probability; else from decision scores; else 0.5. Arguments are arrays of doubles.

    One score: sigmoid of its size. Several scores: largest softmax share.
    """
    if probability is not None:
        return F.array_max(probability)
    if margins is None:
        return F.lit(0.5)
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda acc, m: acc + F.exp(m - top))
    single = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs(margins[0])))
    return F.when(F.size(margins) == 1, single).otherwise(F.lit(1.0) / total)


def binary_label(c: Column) -> Column:
    """1, 0, or NULL for a text that is neither."""
    text = F.trim(F.lower(c.cast("string")))
    return F.when(text.isin(*POSITIVE_LABELS), F.lit(1)).when(text.isin(*NEGATIVE_LABELS), F.lit(0))


def anomaly_metrics(scored: DataFrame, score: str, flag: str, contamination: float = 0.1, label: str | None = None) -> DataFrame:
    """Counts, score statistics, and precision/recall/f1 if every label reads as binary."""
    p90, threshold = exact_quantiles(scored, [score], [0.9, 1.0 - contamination])[score]
    flagged = F.col(flag).cast("bigint")
    aggs = {
        "anomaly_count": F.coalesce(F.sum(flagged), F.lit(0)).cast("double"),
        "anomaly_rate": F.coalesce(F.avg(flagged.cast("double")), F.lit(0.0)),
        "score_mean": F.coalesce(F.avg(score), F.lit(0.0)),
    }
    names = list(aggs)
    if label:
        y = binary_label(F.col(f"`{label}`"))
        aggs |= {
            "_ok": F.bool_and(y.isNotNull()) & (F.min(y) < F.max(y)),
            "_tp": F.sum(y * flagged), "_pos": F.sum(y), "_hit": F.sum(flagged),
        }
    wide = scored.agg(*[v.alias(k) for k, v in aggs.items()])
    wide = wide.withColumns({"score_p90": F.lit(p90 or 0.0), "threshold": F.lit(threshold or 0.0)})
    names += ["score_p90", "threshold"]
    if not label:
        return _long(wide, names)
    known = F.col("_ok")
    wide = wide.withColumns({
        "precision": F.when(known, F.coalesce(F.try_divide("_tp", "_hit"), F.lit(0.0))),
        "recall": F.when(known, F.coalesce(F.try_divide("_tp", "_pos"), F.lit(0.0))),
        "f1": F.when(known, F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_hit") + F.col("_pos")), F.lit(0.0))),
    })
    return _long(wide, names + ["precision", "recall", "f1"]).filter(F.col("value").isNotNull())


def silhouette_squared(df: DataFrame, cols: list[str], cluster: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact in one pass over the rows.

    The mean squared distance to a cluster follows from its size, mean and mean square,
    so no pair of rows is formed. Clusters are carried as arrays of statistics, about
    _CLUSTER_BLOCK in each; with more clusters, rows meet one array after the other. Fewer
    than two clusters are refused.
    """
    from tablescope.session import materialize

    moments = df.groupBy(F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("k"), F.array(*[F.avg(c) for c in cols]).alias("m"),
        F.avg(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])).alias("q"),
    )
    moments = materialize(moments)
    count = moments.count()
    if count < 2:
        raise ValueError("silhouette compares clusters: at least two are needed")
    blocks = -(-count // _CLUSTER_BLOCK)
    dealt = moments.withColumn("_b", F.pmod(F.xxhash64("_c"), F.lit(blocks)))
    x = F.array(*[F.col(c).cast("double") for c in cols])
    own = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)

    def spread(s):
        dot = F.aggregate(F.zip_with(x, s["m"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(own - 2 * dot + s["q"], F.lit(0.0))

    rows = df.withColumns({"_one": F.lit(1), "_a": F.lit(None).cast("double"), "_near": F.lit(None).cast("double")})
    for i in range(blocks):
        block = dealt.filter(F.col("_b") == i).agg(F.collect_list(F.struct(F.col("_c").alias("c"), "k", "m", "q")).alias("_s")).withColumn("_one", F.lit(1))
        mine = F.get(F.filter("_s", lambda s: s["c"] == F.col(cluster)), F.lit(0))
        others = F.filter("_s", lambda s: s["c"] != F.col(cluster))
        rows = rows.join(F.broadcast(block), "_one").withColumns({
            "_a": F.coalesce("_a", F.when(mine["k"] > 1, spread(mine) * mine["k"] / (mine["k"] - 1))),
            "_near": F.least("_near", F.array_min(F.transform(others, spread))),
        }).drop("_s")
    a, b = F.col("_a"), F.col("_near")
    value = F.when(a.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return rows.agg(F.avg(value).alias("silhouette_squared"))
