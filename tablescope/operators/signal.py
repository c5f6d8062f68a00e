"""How much does each feature tell about the target? Mutual information and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.values import canon_str, column_kinds, numeric_of, present
from tablescope.operators.ordering import exact_quantiles
from tablescope.operators.profile import data_profile
from tablescope.operators.target import target_kind
from tablescope.session import materialize, small

# Names of the kinds of score.
MUTUAL, CORRELATION, IMPORTANCE = "mutual_information", "correlation", "permutation_importance"

BINS = 10
CATEGORIES = 100
_OTHER = "other"


def _bin(x: Column, cuts: Sequence[float]) -> Column:
    """Number of distinct cuts below ``x``, as text; NULL for a missing value."""
    place = F.lit(0)
    for cut in sorted(set(cuts)):
        place = place + F.when(x > F.lit(cut), 1).otherwise(0)
    return F.when(x.isNotNull(), place.cast("string"))


def _cuts(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    found = exact_quantiles(df, list(cols), [i / bins for i in range(1, bins)])
    return {c: [v for v in q if v is not None] for c, q in found.items()}


def joint_counts(df: DataFrame, features: Sequence[str], label: str, task: str, bins: int = BINS, categories: int = CATEGORIES) -> DataFrame:
    """(feature, part, class, n): how often each part of each feature meets each class of the target.

    Parts of a number are its ``bins`` exact quantile bins (fewer where cuts coincide), parts
    of anything else its ``categories`` most frequent texts (ties to the smaller), all others
    folded into one part marked ``is_rest``. A missing value is a part of its own (NULL). The
    target's classes are its values, or quantile bins for regression; rows without target do
    not count. All features are counted in one pass with partial aggregation, so a dominant
    value is one row per task; what is left after folding is at most (categories + 2) x
    classes rows for each feature.
    """
    numeric, _ = column_kinds(df, list(features))
    target = numeric_of(df, label) if task == "regression" else F.when(present(df, label).isNotNull(), canon_str(F.col(f"`{label}`")))
    known = df.filter(target.isNotNull())
    cuts = _cuts(known, [*numeric, *([label] if task == "regression" and label not in numeric else [])], bins)
    label_class = _bin(target, cuts[label]) if task == "regression" else target
    pairs = F.array(*[
        F.struct(F.lit(i).alias("f"), (_bin(numeric_of(df, c), cuts[c]) if c in numeric else present(df, c).cast("string")).alias("part"))
        for i, c in enumerate(features)
    ])
    counted = known.select(label_class.alias("class"), F.explode(pairs).alias("p")).groupBy("p.f", "p.part", "class").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in features])
    wide = [i for i, c in enumerate(features) if c not in numeric]
    if wide:
        counted = materialize(counted)
        texts = counted.filter(F.col("f").isin(*wide) & F.col("part").isNotNull())
        totals = texts.groupBy("f", "part").agg(F.sum("n").alias("_all"))
        # a rank limit is applied in each task before rows meet, so a column of distinct texts is not sorted as a whole
        ranked = totals.withColumn("_rank", F.row_number().over(W.partitionBy("f").orderBy(F.desc("_all"), "part"))).filter(F.col("_rank") <= categories)
        kept = F.broadcast(ranked.select(F.col("f").alias("_f"), F.col("part").alias("_kept")))  # categories x features rows at most
        met = texts.join(kept, (F.col("f") == F.col("_f")) & (F.col("part") == F.col("_kept")), "left").select(
            "f", F.col("_kept").alias("part"), "class", "n", F.col("_kept").isNull().alias("is_rest"))
        folded = met.groupBy("f", "part", "is_rest", "class").agg(F.sum("n").alias("n"))
        plain = counted.filter(~F.col("f").isin(*wide) | F.col("part").isNull()).withColumn("is_rest", F.lit(False))
        counted = folded.unionByName(plain)
    else:
        counted = counted.withColumn("is_rest", F.lit(False))
    return counted.select(F.get(names, F.col("f")).alias("feature"), F.when(F.col("is_rest"), F.lit(_OTHER)).otherwise(F.col("part")).alias("part"), "is_rest", "class", "n")


def mutual_information(joint: DataFrame) -> DataFrame:
    """(feature, score): mutual information in nats from a table of ``joint_counts``."""
    by_part = W.partitionBy("feature", "part", "is_rest")
    by_class = W.partitionBy("feature", "class")
    shares = joint.withColumns({"_part": F.sum("n").over(by_part), "_class": F.sum("n").over(by_class)})
    n, both = F.sum("n"), F.col("n") * F.log(F.col("n") / (F.col("_part") * F.col("_class").cast("double")))
    # sum n/N ln(n N / (part class)) = ln N + sum n ln(n / (part class)) / N
    return shares.groupBy("feature").agg(F.greatest(F.lit(0.0), F.log(n) + F.sum(both) / n).alias("score"))


def feature_signal(
    df: DataFrame, features: Sequence[str], label: str, task: str = "auto", bins: int = BINS, categories: int = CATEGORIES,
    importance: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """feature, score_kind, score, warning_flags; one row per feature and kind of score.

    ``mutual_information`` (nats) for every feature; for a regression target also ``correlation``
    (Pearson, over rows with both values; 0 where a side is constant) for every numeric one;
    ``permutation_importance`` where a (feature, score) table is given. Flags are those of the
    data profile. A constant feature or target, or a table without rows, scores 0.
    """
    features = [c for c in features if c != label]
    if task == "auto":
        task = target_kind(df, [label]).first()["target_kind"]
    known = df.select(*dict.fromkeys([*features, label]))
    scores = mutual_information(joint_counts(known, features, label, task, bins, categories)).withColumn("score_kind", F.lit(MUTUAL))
    listed = known.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features)], "feature string, position int")
    scores = F.broadcast(listed).join(scores, "feature", "left").select(
        "feature", "position", F.lit(MUTUAL).alias("score_kind"), F.coalesce("score", F.lit(0.0)).alias("score"))
    numeric, _ = column_kinds(df, features)
    if task == "regression" and numeric:
        y = numeric_of(known, label)
        wide = known.agg(*[F.corr(numeric_of(known, c), y).alias(f"r{i}") for i, c in enumerate(numeric)])
        cells = F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit(features.index(c)).alias("position"), F.lit(CORRELATION).alias("score_kind"),
                     F.coalesce(F.nanvl(F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0)).alias("score")) for i, c in enumerate(numeric)])
        scores = scores.unionByName(wide.select(F.inline(cells)))
    if importance is not None:
        scores = scores.unionByName(importance.join(listed, "feature").select("feature", "position", F.lit(IMPORTANCE).alias("score_kind"), F.col("score").cast("double").alias("score")))
    flags = data_profile(known.select(*features), approx).select(F.col("name").alias("feature"), "warning_flags")
    return scores.join(small(flags), "feature").select("feature", "score_kind", "score", "warning_flags", "position").orderBy("score_kind", F.desc(F.abs("score")), "position").drop("position")


def strongest(signal: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` features by mutual information that carry no warning, and those to leave out.

    Returns (feature, advice): ``use`` for the strongest, ``exclude`` for features with a warning.
    """
    own = signal.filter(F.col("score_kind") == MUTUAL)
    risky = own.filter(F.size("warning_flags") > 0).select("feature", F.lit("exclude").alias("advice"))
    good = own.filter((F.size("warning_flags") == 0) & (F.col("score") > 0)).orderBy(F.desc("score"), "feature").limit(top)
    return good.select("feature", F.lit("use").alias("advice")).unionByName(risky)
