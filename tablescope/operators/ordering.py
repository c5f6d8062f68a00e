"""Exact global order statistics without a single-task sort.

Row numbers, quantiles and "first n in hash order" cuts for tables of any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablescope.functions.values import numeric_of
from tablescope.session import materialize, small

# Up to this many values the one-pass exact aggregate is used; its state is bounded by it.
ONE_PASS_VALUES = 500_000
# Values fetched in the last narrowing step.
_FETCH_VALUES = 50_000
_SKETCH_ACCURACY = 10_000


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = "_row_id") -> DataFrame:
    """1..n in the given order.

    Range-partitioned sort; each partition numbers its own rows and the running
    partition counts (one number per partition) are added. The sorted table is
    written once, so both steps see the same partitions even if executors are lost.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in order_by]
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialize(ranged)
    counts = stored.groupBy("_part").agg((F.max("_local") + 1).alias("n")).orderBy("_part").collect()
    total, offsets = 0, []
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["n"]
    # one row per sort partition: small enough to reach every task
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _start bigint"))
    number = (F.col("_local") + F.col("_start") + 1).cast("bigint")
    return stored.join(starts, "_part").withColumn(name, number).drop("_part", "_local", "_start")


def number_within(df: DataFrame, group: str, order_by: Sequence[str | Column], name: str = "_row_id") -> DataFrame:
    """1..n in the given order inside each group: numbers of the whole table less those of the groups before.

    A group with most of the rows is spread over as many sort partitions as it fills.
    """
    numbered = number_rows(df, [group, *order_by], "_n")
    first = small(numbered.groupBy(F.col(f"`{group}`").alias("_g")).agg((F.min("_n") - 1).alias("_before")))
    return numbered.join(first, F.col(f"`{group}`").eqNullSafe(F.col("_g"))).withColumn(name, F.col("_n") - F.col("_before")).drop("_n", "_g", "_before")


def with_row_id(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return number_rows(df, order_by, "_row_id")


class _Target:
    """One (column, rank range) being narrowed to values ``lo``..``hi``."""

    def __init__(self, col: str, prob: float, n: int):
        self.col, self.n = col, n
        position = prob * (n - 1)
        self.first, self.last = math.floor(position), math.ceil(position)
        self.weight = position - self.first
        self.lo: float | None = None
        self.hi: float | None = None
        self.below, self.inside = 0, n

    def probes(self) -> list[float]:
        """Sketch probabilities, inside the current bracket, that enclose both ranks."""
        slack = 2.0 / _SKETCH_ACCURACY
        return [
            min(1.0, max(0.0, (self.first - self.below) / self.inside - slack)),
            min(1.0, max(0.0, (self.last - self.below + 1) / self.inside + slack)),
        ]

    def bracket(self, x: Column) -> Column:
        return x if self.lo is None else F.when(x.between(self.lo, self.hi), x)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, missing values left out.

    Small inputs use the exact aggregate. Larger ones narrow a value bracket per
    quantile with a sketch (its rank error is bounded, so the bracket is certain),
    count below it, and fetch only the few values left inside. Memory per task stays
    constant; every round is one pass for all columns and quantiles together.
    """
    if not cols:
        return {}
    values = df.select(*[numeric_of(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    counts = values.agg(*[F.count(F.col(f"v{i}")).alias(f"n{i}") for i in range(len(cols))]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(cols)}
    if sum(sizes.values()) <= ONE_PASS_VALUES:
        aggs = [
            F.percentile(F.col(f"v{i}"), F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}")
            for i in range(len(cols))
        ]
        row = values.agg(*aggs).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs) for i, c in enumerate(cols)}

    slots = {c: F.col(f"v{i}") for i, c in enumerate(cols)}
    targets = {(c, p): _Target(c, p, sizes[c]) for c in cols for p in probs if sizes[c]}
    _narrow(values, slots, list(targets.values()))
    found = _fetch(values, slots, list(targets.values()))
    return {c: [found.get(targets[(c, p)]) if (c, p) in targets else None for p in probs] for c in cols}


def _narrow(values: DataFrame, slots: dict[str, Column], targets: list[_Target]) -> None:
    open_ = targets
    while open_:
        sketch = []
        for i, t in enumerate(open_):
            x = t.bracket(slots[t.col])
            sketch.append(F.percentile_approx(x, t.probes(), _SKETCH_ACCURACY).alias(f"b{i}"))
        row = values.agg(*sketch).first()
        tallies = []
        for i, t in enumerate(open_):
            new = (float(row[f"b{i}"][0]), float(row[f"b{i}"][1]))
            t.stuck = new == (t.lo, t.hi)
            t.lo, t.hi = new
            x = slots[t.col]
            tallies += [F.count_if(x < t.lo).alias(f"l{i}"), F.count_if(x.between(t.lo, t.hi)).alias(f"m{i}")]
        row = values.agg(*tallies).first()
        for i, t in enumerate(open_):
            t.below, t.inside = row[f"l{i}"], row[f"m{i}"]
            if not (t.below <= t.first and t.last < t.below + t.inside):
                raise RuntimeError("quantile bracket missed its rank")
        open_ = [t for t in open_ if t.inside > _FETCH_VALUES and t.lo != t.hi and not t.stuck]


def _fetch(values: DataFrame, slots: dict[str, Column], targets: list[_Target]) -> dict[_Target, float]:
    """Values at both ranks of each target, from value counts inside the bracket."""
    pairs = F.array(*[
        F.when(slots[t.col].between(t.lo, t.hi), F.struct(F.lit(i).alias("t"), slots[t.col].alias("x")))
        for i, t in enumerate(targets)
    ])
    counted = (
        values.select(F.explode(F.array_compact(pairs)).alias("p"))
        .groupBy("p.t", "p.x").agg(F.count(F.lit(1)).alias("c"))
    )
    seen: dict[int, list[Row]] = {}
    for row in counted.orderBy("t", "x").collect():
        seen.setdefault(row["t"], []).append(row)
    out = {}
    for i, t in enumerate(targets):
        rank, picked = t.below, {}
        for row in seen[i]:
            for want in (t.first, t.last):
                if want not in picked and want < rank + row["c"]:
                    picked[want] = row["x"]
            rank += row["c"]
        lo, hi = picked[t.first], picked[t.last]
        out[t] = lo + (hi - lo) * t.weight
    return out


def hash_order(cols: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random order: md5 of the key text and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in cols], F.lit(str(seed))))


def cut_values(
    df: DataFrame, group: Column, order: Column, wanted: DataFrame, limits: Sequence[str], rows: int
) -> DataFrame:
    """For each group, the ``order`` value of its n-th row, for every n in ``limits``.

    ``wanted`` has one row per group (column ``_group``) with a count per limit. Rows are
    counted by the leading hex digits of the hash; only the rows sharing the digits of a
    cut are ranked. No group is sorted as a whole and the main table is not shuffled.
    ``rows`` sets the number of digits: about a million rows share them at most.
    """
    digits = max(3, math.ceil(math.log(max(1, rows / 1e6), 16)))
    keyed = df.select(group.alias("_group"), order.alias("_order"))
    prefix = F.substring("_order", 1, digits).alias("_prefix")
    tally = keyed.groupBy("_group", prefix).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window as W

    upto = W.partitionBy("_group").orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = tally.withColumn("_upto", F.sum("_n").over(upto)).join(wanted, "_group")
    crossing = [
        running.filter((F.col(c) > F.col("_upto") - F.col("_n")) & (F.col(c) <= F.col("_upto"))).select(
            "_group", "_prefix", F.lit(c).alias("_limit"), (F.col(c) - F.col("_upto") + F.col("_n")).alias("_pick")
        )
        for c in limits
    ]
    cuts = reduce(DataFrame.unionByName, crossing)
    near = keyed.withColumn("_prefix", prefix).join(cuts, ["_group", "_prefix"])
    place = W.partitionBy("_group", "_limit").orderBy("_order")
    hit = near.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") == F.col("_pick"))
    return hit.groupBy("_group").agg(*[F.max(F.when(F.col("_limit") == c, F.col("_order"))).alias(f"_cut_{c}") for c in limits])
