"""Sharding by extendible hashing: only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.session import materialize, small

#: Hash bits, and how many of them a round of the directory looks at.
BITS = 60
STEP = 10


def hash60(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text; null keys hash like empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _top(value: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the 60 bits."""
    shift = (BITS - F.lit(depth)).cast("int") if isinstance(depth, int) else (F.lit(BITS) - depth).cast("int")
    return F.call_function("shiftright", value, shift)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, bytes): the shards over rows (h, bytes), each within ``limit``.

    One pass sums bytes per prefix for the next STEP depths; a prefix that fits, below one
    that does not, is a shard. Only rows under prefixes that are still too large go on to
    the next round. What is left when all bits are used has one hash: it stays one shard.
    """
    rows, base, out = sizes, 0, None
    while True:
        last = min(base + STEP, BITS)
        finest = rows.groupBy(_top(F.col("h"), last).alias("p")).agg(F.sum("bytes").alias("bytes"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(last)))
        nodes = materialize(finest.select("p", "bytes", depths.alias("depth")).groupBy(
            F.call_function("shiftright", F.col("p"), (F.lit(last) - F.col("depth")).cast("int")).alias("prefix"), "depth",
        ).agg(F.sum("bytes").alias("bytes")))
        large = nodes.filter((F.col("bytes") > limit) & (F.col("depth") < BITS)).select("prefix", "depth")
        fits = nodes.filter((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        parent = large.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        found = fits.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(
            parent, ["depth", "up"], "left_semi").select("prefix", "depth", "bytes")
        if base == 0:
            found = found.unionByName(fits.filter("depth = 0").select("prefix", "depth", "bytes"))
        out = found if out is None else out.unionByName(found)
        open_ = large.filter(F.col("depth") == last).select(F.col("prefix").alias("_p"))
        if last == BITS or open_.isEmpty():
            return materialize(out)
        rows = rows.withColumn("_p", _top(F.col("h"), last)).join(open_, "_p", "left_semi").drop("_p")
        base = last


def assign_shards(rows: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``rows`` with shard (its bits as text), shard_depth and shard_bytes.

    ``size`` is the byte size of a row (default: UTF-8 bytes of ``text``, null counts 0).
    Shards hold at most ``limit`` bytes. Rows of one key share all bits: where they are too
    many for a shard, they are told apart by a running byte count into parts ``bits.0``,
    ``bits.1`` .., each within the limit. A row larger than the limit is a part alone. An
    empty table has no shard. Columns of these names are replaced.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if size is None else size
    hashed = rows.withColumns({"_h": hash60(F.col(key)), "_bytes": size})
    table = directory(hashed.select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes")), limit)
    depths = [r[0] for r in table.select("depth").distinct().collect()]  # 61 at most
    if not depths:
        depths = [0]
    lookup = small(table.select(F.col("prefix").alias("_prefix"), F.col("depth").alias("_depth"), F.col("bytes").alias("_total")))
    fitted = hashed.withColumn("_depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))).withColumn(
        "_prefix", _top(F.col("_h"), F.col("_depth"))).join(lookup, ["_prefix", "_depth"])
    bits = F.when(F.col("_depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("_prefix").cast("string"), 10, 2), F.col("_depth"), F.lit("0")))
    named = fitted.withColumns({"shard": bits, "shard_depth": F.col("_depth"), "shard_bytes": F.col("_total")})
    whole = named.filter((F.col("_total") <= limit) | (F.col("_depth") < BITS))
    if BITS not in depths:
        return whole.drop("_h", "_bytes", "_depth", "_prefix", "_total")
    same = named.filter((F.col("_total") > limit) & (F.col("_depth") == BITS))
    # A row starts at the multiple of the limit its running count is in, or at the next one if it would cross it:
    # with rows of at most half the limit, counting in halves keeps every part within the limit.
    order = W.partitionBy("_h").orderBy(F.xxhash64(*[c for c in rows.columns if c != key]), "_bytes")
    before = F.sum("_bytes").over(order.rowsBetween(W.unboundedPreceding, -1))
    slot = F.floor(F.coalesce(before, F.lit(0)) / F.greatest(F.lit(1), F.lit(limit // 2)))
    parts = same.withColumn("_slot", slot).withColumn(
        "_slot", F.when(F.col("_bytes") > limit // 2, F.concat_ws("_", F.col("_slot"), F.row_number().over(order))).otherwise(
            F.col("_slot").cast("string")))
    parts = parts.withColumn("shard", F.concat_ws(".", "shard", "_slot")).withColumn(
        "shard_bytes", F.sum("_bytes").over(W.partitionBy("shard")))
    return whole.unionByName(parts.drop("_slot")).drop("_h", "_bytes", "_depth", "_prefix", "_total")


def write_shards(rows: DataFrame, path: str, limit: int, key: str = "doc_id") -> None:
    """Write ``rows`` below ``path``, one folder ``shard=bits`` of Parquet per shard."""
    assigned = assign_shards(rows, limit, key)
    assigned.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
