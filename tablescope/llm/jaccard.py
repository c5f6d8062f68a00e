"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

Which texts meet in a tile is decided by prefix filtering: two sets of the wanted
similarity share one of their first ``n - ceil(t * n) + 1`` shingles in any common order,
so no link is lost whatever the order is. The order: shingles with hashes in the lowest
part of the range that one text has alone, then those of more texts by how many, then all
others by hash. A text with enough shingles of its own is done before any set is compared.

Equal sets are one node from the start. Nodes and shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.columns import arrow_rows
from tablescope.operators.components import connected_components
from tablescope.session import materialize

#: Rows of an Arrow batch: texts and shingle arrays are long.
BATCH_ROWS = 500
#: Members of a block; a tile compares two blocks.
BLOCK = 512
#: Rows up to which the ids of candidate documents are broadcast (16 MB); beyond it, they are shuffled.
BROADCAST_ROWS = 1_000_000

#: Odd multiplier of the polynomial hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _power_table(size: int) -> np.ndarray:
    out = np.full(size, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1; tables grow in steps, so most texts share one."""
    return _power_table(1 << max(16, int(n - 1).bit_length()))[:n]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of ``text`` (A-Z lower-cased).

    Words are runs of characters other than space and tab to carriage return. A text with
    fewer words gives its whole sequence as one shingle, one without words an empty set. A
    word's hash is the mixed polynomial of its bytes, a shingle's the mixed polynomial of
    its word hashes, all words of a text at once.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    if not len(edge):
        return np.empty(0, dtype=np.uint64)
    starts, ends = edge[::2], edge[1::2]
    # Position from the word's start gives the power, so equal words get equal sums anywhere.
    begun = np.zeros(len(raw), dtype=np.int64)
    begun[starts] = starts
    offset = np.arange(len(raw)) - np.maximum.accumulate(begun)
    value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw))[offset], np.uint64(0))
    word = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    n = len(word)
    if n < words:
        return _mix(np.array([np.sum(word * _powers(n + 2)[1:n + 1], dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    total = np.zeros(n - words + 1, dtype=np.uint64)
    for j in range(words):
        total += word[j:n - words + 1 + j] * _powers(words + 2)[j + 1]
    return np.unique(_mix(total + np.uint64(words)))


def set_key(hashes: np.ndarray) -> int:
    """64-bit hash of a set; 0 for the empty set."""
    if not len(hashes):
        return 0
    total = np.sum(_mix(hashes + np.uint64(0x1234567)), dtype=np.uint64) + np.uint64(len(hashes))
    return int(_mix(np.array([total], dtype=np.uint64)).view(np.int64)[0]) or 1


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def lowest(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The shingles whose frequency is counted: all in the lowest part of the hash range, a
    third wider than the mean prefix, and at least as many as the prefix has."""
    share = min(0.99, (100 - percent) / 75)
    size = max(prefix_size(len(hashes), percent), int(np.searchsorted(hashes, np.uint64(int(share * 2**64)))))
    return hashes[:size]


def _features(words: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A set met before in the same partition gives no shingles again."""
        met: set[int] = set()
        for b in batches:
            rows = []
            for i, row, t in zip(b["id"], b["row"], b["text"]):
                s = shingle_set(t, words)
                k = set_key(s)
                rows.append((i, row, len(s), k, lowest(s, percent).view(np.int64).copy() if k not in met else s[:0].view(np.int64)))
                met.add(k)
            yield pd.DataFrame(rows, columns=["id", "row", "n", "k", "tokens"]).astype({"id": "Int64"})

    return run


def _sets(words: int) -> Callable[[Column], Column]:
    @F.pandas_udf("struct<k:long,h:array<long>>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, words)
            rows.append((set_key(s), s.view(np.int64)))
        return pd.DataFrame(rows, columns=["k", "h"])

    return sets


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, for sorted arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = len(large) - 1
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set; the width suits the largest set, at most 8,192 bits."""
    bits = 1 << min(13, max(6, math.ceil(math.log2(max(2, 2 * max(map(len, sets)))))))
    out = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for i, s in enumerate(sets):
        hit = np.zeros(bits, dtype=bool)
        hit[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        out[i] = np.packbits(hit)
    return out.view(np.uint64)


class _Groups:
    """Union-find over small arrays of labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (u := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(u, u)
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def compare_tile(side: np.ndarray, comp: np.ndarray, k: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different components of one tile, enough to connect them.

    ``side`` is 0 or 1 for the two blocks, or all 0 where a block meets itself. For a pair
    of set sizes a and b the overlap must be at least percent / (100 + percent) * (a + b);
    the bits one bitmap has and the other lacks bound it from above. Pairs of one component
    are skipped, also those that became one in this tile.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    maps = bitmaps(sets)
    groups, out = _Groups(), []
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    itself = right is left
    for p, i in enumerate(left):
        others = right[p + 1:] if itself else right
        others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        if not len(others):
            continue
        own = n[i] - np.bitwise_count(maps[i] & ~maps[others]).sum(axis=1, dtype=np.int64)
        theirs = n[others] - np.bitwise_count(maps[others] & ~maps[i]).sum(axis=1, dtype=np.int64)
        others = others[(100 + percent) * np.minimum(own, theirs) >= percent * (n[others] + n[i])]
        for j in others:
            if groups.find(int(comp[i])) != groups.find(int(comp[j])) and linked(sets[i], sets[j], percent):
                groups.join(int(comp[i]), int(comp[j]))
                out.append((int(k[i]), int(k[j])))
    return out


def _tiles(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile; the rows of a tile may spread over batches."""
        held: list[pd.DataFrame] = []

        def done(tile: pd.DataFrame) -> list[tuple[int, int]]:
            tile = tile.drop_duplicates(["side", "k"])
            sets = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in tile["h"]]
            return compare_tile(tile["side"].to_numpy(), tile["comp"].to_numpy(), tile["k"].to_numpy(), sets, percent)

        for batch in batches:
            tile = batch["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(batch)]
            links: list[tuple[int, int]] = []
            for s, e in zip(cuts, cuts[1:]):
                if held and held[0]["tile"].iloc[0] != tile[s]:
                    links += done(pd.concat(held))
                    held = []
                held.append(batch.iloc[s:e])
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(done(pd.concat(held)), columns=["a", "b"], dtype="int64")

    return run


def _verify(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [linked(np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(y, dtype=np.int64).view(np.uint64), percent)
                  for x, y in zip(b["ha"], b["hb"])]
            yield b.loc[ok, ["a", "b"]]

    return run


def _band(n: Column, percent: int) -> Column:
    """Sizes of one band differ by less than the ratio; sizes that can link are at most one band apart."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _tile_rows(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(tile, side, k, comp, h) for members (g, k, comp, n) of groups with several components.

    In each group the largest component is apart from the rest. Blocks are (group, part,
    band, number), numbers dealt by hash so that a block has about BLOCK members; tiles are
    pairs of blocks whose bands touch, without pairs inside the largest component.
    """
    sizes = materialize(members.groupBy("g", "comp").count())
    main = sizes.groupBy("g").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    banded = materialize(members.join(main.drop("comps"), "g").select(
        "g", "k", "comp", (F.col("comp") == F.col("main")).cast("int").alias("part"), _band(F.col("n"), percent).alias("band")))
    held = banded.groupBy("g", "part", "band").count().select("g", "part", "band", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    held = materialize(held)
    blocks = held.select("g", "part", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no"))
    left = blocks.select("g", F.col("part").alias("p1"), F.col("band").alias("b1"), F.col("no").alias("n1"))
    right = blocks.select("g", F.col("part").alias("p2"), F.col("band").alias("b2"), F.col("no").alias("n2"),
                          F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("b1"))
    pairs = left.join(right, ["g", "b1"]).filter(
        (F.col("p1") + F.col("p2") < 2) & (F.struct("p1", "b1", "n1") <= F.struct(F.col("p2"), F.col("b2"), F.col("n2"))))
    tiles = materialize(pairs.withColumn("tile", F.xxhash64("g", "p1", "b1", "n1", "p2", "b2", "n2")))
    same = (F.col("p1") == F.col("p2")) & (F.col("b1") == F.col("b2")) & (F.col("n1") == F.col("n2"))
    placed = banded.join(held, ["g", "part", "band"]).select(
        "g", "part", "band", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("no"), "k", "comp")
    ends = tiles.select("tile", "g", F.col("p1").alias("part"), F.col("b1").alias("band"), F.col("n1").alias("no"), F.lit(0).alias("side")).unionByName(
        tiles.filter(~same).select("tile", "g", F.col("p2").alias("part"), F.col("b2").alias("band"), F.col("n2").alias("no"), F.lit(1).alias("side")))
    return ends.join(placed, ["g", "part", "band", "no"]).select("tile", "side", "k", "comp").join(sets, "k")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, n_shingles, component_id, leads) per row of ``docs``.

    Two rows link when 100 * intersection >= percent * union of their shingle sets; a
    component is everything reachable by links, named by its smallest key. Rows without
    words (null, empty or blank text) link with nothing, not with each other. Null keys take
    part and never name a component unless it has no other. Repeated rows and keys all come
    back. ``leads`` marks the row that stands for its component: the smallest (key,
    text_hash), null keys last; rows without words lead themselves. Other columns are left out; an empty table gives an empty result.

    Steps: shingles of the lowest hash range per row; those of two or more nodes; per node,
    how many of its own prefix are among them (often none: the node is done); a star per
    shared prefix shingle around its smallest node, so a shingle of K nodes costs K rows;
    each node is compared with the star node it shares most shingles with; only stars whose
    members are not yet one component go on to tiles, where pairs of different components
    are compared. No pair is written unless it links two components. The key must be an
    integer column.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        rows = materialize(source.mapInPandas(_features(words, percent), "id long, row long, n long, k long, tokens array<long>"))
    facts = rows.filter(F.size("tokens") > 0).groupBy("k").agg(
        F.first("n").alias("n"), F.first(F.size("tokens")).alias("own"), F.min("id").alias("id"))
    emitted = rows.select("k", F.explode("tokens").alias("t"))
    counts = emitted.groupBy("t").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("times")).filter("low < high").select("t", "times")
    shared = emitted.join(materialize(counts), "t")
    # A node met in several partitions has the same rows several times: the set keeps one of each.
    per_node = shared.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("times", "t"))).alias("shared")).join(facts, "k")
    want = (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1) - (F.col("own") - F.size("shared"))
    kept = materialize(per_node.filter(want > 0).select("k", "n", "id", F.explode(F.slice("shared", 1, want.cast("int"))["t"]).alias("t")))
    hubs = kept.groupBy("t").agg(F.min("k").alias("hub"), F.max("k").alias("last")).filter("hub < last").select("t", "hub")
    stars = materialize(kept.join(hubs, "t").groupBy("k", "hub").agg(
        F.count("*").alias("shared"), F.first("n").alias("n"), F.first("id").alias("id")))
    near = materialize(stars.select("k", "n", "id").distinct())
    wanted = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    chosen = source.join(wanted.select(F.col("id").alias("_id"), F.col("k").alias("_k")), F.col("id").eqNullSafe(F.col("_id")))
    with arrow_rows(spark, BATCH_ROWS):
        sets = materialize(chosen.select("_k", _sets(words)(F.col("text")).alias("s")).filter("s.k = _k").select("s.k", "s.h"))
    first = stars.filter("k <> hub").groupBy("k").agg(F.max_by("hub", F.struct("shared", "hub")).alias("b")).withColumnRenamed("k", "a")
    tried = first.join(sets.select(F.col("k").alias("a"), F.col("h").alias("ha")), "a").join(
        sets.select(F.col("k").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
    with arrow_rows(spark, BATCH_ROWS):
        links = materialize(tried.mapInPandas(_verify(percent), "a long, b long"))
    points = near.select(F.col("k").alias("node"))
    comps = connected_components(points, links).withColumnRenamed("node", "k").withColumnRenamed("component", "comp")
    members = stars.select(F.col("hub").alias("g"), "k", "n").join(comps, "k")
    tiled = _tile_rows(members, sets, percent)
    more = tiled.repartition("tile").sortWithinPartitions("tile").mapInPandas(_tiles(percent), "a long, b long")
    with arrow_rows(spark, BATCH_ROWS):
        both = materialize(links.unionByName(more.distinct()))
    final = connected_components(points, both)
    named = materialize(rows.select("id", "row", "n", "k").join(final.select(F.col("node").alias("k"), "component"), "k", "left").select(
        "id", "row", "n", F.when(F.col("n") > 0, F.coalesce("component", "k")).alias("c")))
    own = F.struct(F.col("id").isNull(), "id", "row")
    # written first, so that the join below has plain exchanges and a large component can be split
    least = materialize(named.filter("n > 0").groupBy("c").agg(F.min("id").alias("low"), F.min(own).alias("first")))
    return named.join(least, "c", "left").select(
        F.col("id").alias(key), F.col("row").alias("text_hash"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | (own == F.col("first"))).alias("leads"))
