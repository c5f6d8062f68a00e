"""Popularity recommendations: the best k items a user has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.values import numeric_of
from tablescope.operators.ordering import number_rows
from tablescope.session import materialize

COUNT_BONUS = 0.01  # fixed value: score added per rating
REASON = "popularity_baseline"  # fixed value


def item_scores(df: DataFrame, item: str, rating: str | None = None) -> DataFrame:
    """(item, score): mean rating plus a small bonus per rating, or plain counts."""
    if rating and rating in df.columns:
        scores = df.select(F.col(f"`{item}`").cast("string").alias("item"), numeric_of(df, rating).alias("r")).filter(
            F.col("item").isNotNull()
        )
        return scores.groupBy("item").agg(
            (F.coalesce(F.avg("r"), F.lit(0.0)) + F.count("r") * F.lit(COUNT_BONUS)).alias("score")
        )
    items = df.select(F.col(f"`{item}`").cast("string").alias("item")).filter(F.col("item").isNotNull())
    return items.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("score"))


def recommend(df: DataFrame, user: str, item: str, rating: str | None = None, k: int = 5) -> DataFrame:
    """Top ``k`` unseen items per user, ties in item order.

    Items are ranked once and cut into blocks of ranks. A user's seen items are only
    counted per block; the user then needs the leading blocks up to the first one it has
    not touched, so candidates per user stay near ``k`` however long the history is.
    """
    width = max(16, 2 * k)
    scores = item_scores(df, item, rating)
    ranked = number_rows(scores, [F.col("score").desc(), F.col("item").asc()], "rank")
    ranked = ranked.withColumn("block", F.floor((F.col("rank") - 1) / width).cast("bigint"))
    seen = df.select(F.col(f"`{user}`").alias("user"), F.col(f"`{item}`").cast("string").alias("item")).filter(
        F.col("user").isNotNull() & F.col("item").isNotNull()
    ).distinct()
    seen = materialize(seen.join(ranked.select("item", "block"), "item"))
    sizes = ranked.groupBy("block").agg(F.count(F.lit(1)).alias("size"))

    touched = seen.groupBy("user", "block").agg(F.count(F.lit(1)).alias("used"))
    in_order = W.partitionBy("user").orderBy("block")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    leading = (
        touched.join(sizes, "block")
        .withColumn("place", F.row_number().over(in_order) - 1)
        .filter(F.col("block") == F.col("place"))
        .withColumn("free", F.col("size") - F.col("used"))
        .withColumn("free_before", F.coalesce(F.sum("free").over(before), F.lit(0)))
    )
    users = seen.select("user").distinct()
    partly = leading.filter((F.col("free") > 0) & (F.col("free_before") < k)).select("user", "block")
    untouched = users.join(leading.groupBy("user").agg(F.count(F.lit(1)).alias("gap")), "user", "left").select(
        "user", F.coalesce("gap", F.lit(0)).cast("bigint").alias("block")
    )
    candidates = partly.unionByName(untouched).join(ranked, "block").join(
        seen.select("user", "item"), ["user", "item"], "left_anti"
    )
    best = W.partitionBy("user").orderBy("rank")
    return (
        candidates.withColumn("_rank", F.row_number().over(best).cast("bigint")).filter(F.col("_rank") <= k)
        .select(
            F.col("user").alias(user), F.col("item").alias("recommended_item_id"),
            F.col("score").alias("_recommendation_score"), "_rank", F.lit(REASON).alias("_recommendation_reason"),
        )
    )


def recommendation_metrics(df: DataFrame, recommended: DataFrame, user: str, item: str, k: int) -> DataFrame:
    source = df.agg(
        F.count_distinct(F.col(f"`{user}`")).cast("double").alias("user_count"),
        F.count_distinct(F.col(f"`{item}`")).cast("double").alias("item_count"),
    )
    result = recommended.agg(
        F.count(F.lit(1)).cast("double").alias("recommendation_count"), F.count_distinct("recommended_item_id").alias("shown")
    )
    # two one-row tables, put side by side as rows of the long result
    counts = source.select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("user_count", "item_count")]
    )))
    made = result.select(F.inline(F.array(
        F.struct(F.lit("recommendation_count").alias("metric"), F.col("recommendation_count").alias("value")),
        F.struct(F.lit("shown").alias("metric"), F.col("shown").cast("double").alias("value")),
    )))
    both = counts.unionByName(made).groupBy().pivot("metric", ["user_count", "item_count", "recommendation_count", "shown"]).agg(F.max("value"))
    both = both.withColumns({
        "coverage": F.col("shown") / F.greatest(F.col("item_count"), F.lit(1.0)), "top_k": F.lit(float(k))
    })
    names = ["user_count", "item_count", "recommendation_count", "coverage", "top_k"]
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))
