"""Reproducible train/test split with exact counts, stratified where possible."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.values import canon_str
from tablescope.operators.ordering import cut_values, hash_order, number_rows
from tablescope.session import materialize, small

# Class tables up to this size get their quotas from one window; larger ones are numbered in parts.
_SMALL_CLASSES = 100_000


def split_sizes(n: int, mode: str, test_size, train_size) -> tuple[int, int]:
    """(train, test) row counts for a table of n rows."""
    if mode == "count":
        if train_size is None and test_size is None:
            raise ValueError("mode count: give the rows of one side or both")
        test = int(test_size) if test_size is not None else n - int(train_size)
        train = int(train_size) if train_size is not None else n - test
        if train <= 0 or test <= 0:
            raise ValueError("both sides of the split need a row")
        if train + test > n:
            raise ValueError(f"{train} + {test} rows asked for, the table has {n}")
        return train, test
    if not 0 < test_size < 1 or (train_size is not None and not 0 < train_size < 1):
        raise ValueError("ratios must be between 0 and 1")
    if train_size is not None and test_size + train_size > 1:
        raise ValueError("ratios must not add up to more than 1")
    test = math.ceil(round(test_size * n, 9))
    train = n - test if train_size is None else math.floor(round(train_size * n, 9))
    if train <= 0:
        raise ValueError("the train part would be empty")
    return train, test


def _shares(classes: DataFrame, size: str, total: int, wanted: int, out: str, few: bool) -> DataFrame:
    """Split ``wanted`` over the classes in proportion to ``size``, largest remainder first."""
    if total == 0:
        return classes.withColumn(out, F.lit(0).cast("bigint"))
    exact = F.col(size) * F.lit(wanted)
    base = classes.withColumns({out: F.floor(exact / F.lit(total)).cast("bigint"), "_rest": exact % F.lit(total)})
    left = wanted - (base.agg(F.sum(out)).first()[0] or 0)
    order = [F.col("_rest").desc(), F.col("_group").asc()]
    if few:
        placed = base.withColumn("_place", F.row_number().over(W.orderBy(*order)))
    else:
        placed = number_rows(base, order, "_place")
    return placed.withColumn(out, F.col(out) + (F.col("_place") <= left).cast("bigint")).drop("_rest", "_place")


def train_test_split(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    mode: str = "ratio",
    test_size=0.2,
    train_size=None,
    seed: int = 42,
    shuffle: bool = True,
) -> DataFrame:
    """``df`` plus ``_split_role`` in train/test/unused.

    Rows are ordered by a hash of their unique ``key``; each class gives its first rows
    to test, the next to train. Only per-class cut values are computed and compared, so
    the table itself is neither sorted nor shuffled and a dominant class is no hot spot.
    """
    if not shuffle:
        return _tail_split(df, mode, test_size, train_size)
    group = canon_str(F.col(f"`{label}`")) if label else F.lit("")
    classes = df.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    facts = classes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"), F.min("_n").alias("low")
    ).first()
    n, k = facts["n"], facts["k"]
    train, test = split_sizes(n, mode, test_size, train_size)
    if label and (k < 2 or facts["low"] < 2 or train < k or test < k):
        return train_test_split(df, key, None, mode, test_size, train_size, seed, shuffle)
    few = k <= _SMALL_CLASSES
    classes = classes if few else materialize(classes)
    quota = _shares(classes, "_n", n, test, "_test", few)
    if train + test == n:
        quota = quota.withColumn("_train", F.col("_n") - F.col("_test"))
    else:
        quota = quota.withColumn("_free", F.col("_n") - F.col("_test"))
        quota = _shares(quota, "_free", n - test, train, "_train", few)
    quota = quota.select("_group", F.col("_test"), (F.col("_test") + F.col("_train")).alias("_both"))
    order = F.concat_ws("|", hash_order(key, seed), *[F.col(f"`{c}`").cast("string") for c in key])
    cuts = cut_values(df, group, order, small(quota), ["_test", "_both"], n)
    if not label:
        row = cuts.first()
        return df.withColumn("_split_role", _role(order, F.lit(row["_cut__test"]), F.lit(row["_cut__both"])))
    keyed = df.withColumns({"_group": group, "_order": order}).join(small(cuts), "_group", "left")
    return keyed.withColumn("_split_role", _role(F.col("_order"), F.col("_cut__test"), F.col("_cut__both"))).select(
        *[F.col(f"`{c}`") for c in df.columns], "_split_role"
    )


def _role(order: Column, test_cut: Column, both_cut: Column) -> Column:
    return F.when(order <= test_cut, F.lit("test")).when(order <= both_cut, F.lit("train")).otherwise(F.lit("unused"))


def _tail_split(df: DataFrame, mode: str, test_size, train_size) -> DataFrame:
    """No shuffling: first rows by ``_row_id`` train, the following ones test."""
    n = df.count()
    train, test = split_sizes(n, mode, test_size, train_size)
    at = F.col("_row_id")
    return df.withColumn(
        "_split_role",
        F.when(at <= train, F.lit("train")).when(at <= train + test, F.lit("test")).otherwise(F.lit("unused")),
    )
