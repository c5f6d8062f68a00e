"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.session import materialize, small

#: Rows of one numbering slice; slices are numbered apart and joined by their offsets.
SLICE_ROWS = 50_000


def token_count(text: Column) -> Column:
    """Words and single other marks of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), F.lit(0)).cast("int")


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend. Layer by layer, ``best[j]`` is the least padding of the first j
    lengths; the last bucket of a solution ends at its longest length. The table has as
    many entries as there are distinct lengths, at most the maximum length of a piece.
    """
    size = np.asarray(lengths, dtype=np.float64)
    held = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    total = np.concatenate([[0.0], np.cumsum(size * np.asarray(counts, dtype=np.float64))])
    n = len(lengths)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        layer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        layer[0] = 0.0
        for j in range(1, n + 1):
            padded = best[:j] + size[j - 1] * (held[j] - held[:j]) - (total[j] - total[:j])
            cut[j] = int(np.argmin(padded))
            layer[j] = padded[cut[j]]
        cuts.append(cut)
        best = layer
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def pack(docs: DataFrame, key: str = "doc_id", tokens: Column | None = None, max_len: int = 8192,
         buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Batches of pieces: key, piece, n_tokens, bucket, bucket_len, batch, slot.

    Rows longer than ``max_len`` tokens give several pieces of that length and a rest; rows
    without tokens (null or empty text) give one piece of 0. ``tokens`` is an integer
    column of token counts (default: counted from ``text``; null or negative counts as 0).
    A batch holds floor(budget / bucket_len) slots of one bucket, at least one, and only
    the last batch of a bucket can be short. Numbers run over the whole bucket: rows are
    dealt to slices by a hash, numbered within a slice by key, and shifted by the slice's
    offset, so no task sorts a whole bucket. Repeated rows stay apart. An empty table gives
    no batch.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    sized = docs.select(F.col(key).alias("_key"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    pieces = materialize(sized.select(
        "_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / max_len) - 1, F.lit(0)).cast("int"))).alias("piece"),
    ).select("_key", "piece", F.least(F.col("_n") - F.col("piece") * F.lit(max_len).cast("long"), F.lit(max_len)).cast("int").alias("n_tokens")))
    rows = sorted(pieces.groupBy("n_tokens").count().collect())  # at most max_len + 1
    lengths, counts = [r[0] for r in rows], [r[1] for r in rows]
    ends = bucket_bounds(lengths, counts, buckets) or [max_len]
    held = [sum(c for x, c in zip(lengths, counts) if (x <= e) and (i == 0 or x > ends[i - 1])) for i, e in enumerate(ends)]
    bounds = F.array(*[F.lit(max(e, 1)) for e in ends])
    slots = F.array(*[F.lit(max(1, budget // max(e, 1))).cast("long") for e in ends])
    slices = F.array(*[F.lit(max(1, -(-h // SLICE_ROWS))) for h in held])
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    dealt = pieces.withColumn("bucket", bucket).withColumn("_slice", F.pmod(
        F.xxhash64("_key", "piece", "n_tokens"), F.get(slices, F.col("bucket"))).cast("int"))
    sums = dealt.groupBy("bucket", "_slice").count()
    before = F.sum("count").over(W.partitionBy("bucket").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = small(sums.select("bucket", "_slice", F.coalesce(before, F.lit(0)).alias("_before")))
    at = F.row_number().over(W.partitionBy("bucket", "_slice").orderBy("_key", "piece", "n_tokens")) - 1
    numbered = dealt.withColumn("_at", at).join(offsets, ["bucket", "_slice"]).withColumn("_at", F.col("_at") + F.col("_before"))
    per = F.get(slots, F.col("bucket"))
    return numbered.select(
        F.col("_key").alias(key), "piece", "n_tokens", "bucket", F.get(bounds, F.col("bucket")).alias("bucket_len"),
        F.floor(F.col("_at") / per).alias("batch"), (F.col("_at") % per).cast("int").alias("slot"))
