"""Merkle manifest of a table: trees per group under one root, proofs by a butterfly exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.columns import let
from tablescope.operators.ordering import number_rows
from tablescope.session import materialize, small

#: Levels of a tree that lie inside one partition group: 3 ** 5 leaves.
LEVELS = 5


def digest(parts: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the fields: ``-`` for null, else byte count, ``:`` and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*fields), 256)


def _join(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda r: F.sha2(_join(F.slice(nodes, r * fanout + 1, fanout)), 256))


def _levels(leaves: Column, whole: Column, levels: int, fanout: int) -> Column:
    """Nodes of each level of one partition's subtree; ``whole``: other partitions share the tree, so all levels are hashed."""
    def up(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(whole | (F.size(last) > 1), F.concat(done, F.array(_parents(last, fanout)))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(leaves), up)


def _steps(levels: Column, k: Column, fanout: int) -> Column:
    """Siblings of leaf ``k`` (from 0) at each level below the partition's own node, and its place among them."""
    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(k / F.pow(F.lit(float(fanout)), level)).cast("int")
        place = at % fanout
        return F.struct(place.alias("place"), F.concat(
            F.slice(nodes, at - place + 1, place), F.slice(nodes, at + 2, fanout - 1 - place)).alias("others"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _round(state: DataFrame, width: int, fanout: int) -> DataFrame:
    """One exchange: partitions whose subtrees of ``width`` partitions share a parent swap the roots of these.

    Partition b sends to the partitions at its own offset in the sibling subtrees. Only the last
    subtree of a tree may be short: its partitions then also serve, in turn, the offsets it lacks.
    Everyone receives each sibling root once, so a receiver's group has ``fanout`` rows at most.
    """
    b, parts = F.col("b"), F.col("parts")
    tree = F.floor(b / width).cast("bigint")
    size = lambda t: F.least(F.lit(width), parts - t * width).cast("bigint")
    first = tree - tree % fanout
    siblings = F.sequence(first, F.least(first + fanout - 1, F.floor((parts - 1) / width).cast("bigint")))
    offset = (b % width).cast("bigint")
    sent = (
        state.withColumns({"tree": tree, "to_tree": F.explode(siblings)})
        .filter(offset < size(F.col("to_tree")))
        .withColumn("to", F.explode(F.sequence(F.col("to_tree") * width + offset, F.col("to_tree") * width + size(F.col("to_tree")) - 1, size(F.col("tree")))))
    )
    own = F.col("tree") == F.col("to_tree")
    got = sent.groupBy("g", F.col("to").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("tree", "node"))).alias("run"), F.max(F.col("parts")).alias("parts"),
        F.max(F.when(own, F.col("tree"))).alias("mine"), F.max(F.when(own, F.col("steps"))).alias("steps"))
    others = F.transform(F.filter("run", lambda x: x["tree"] != F.col("mine")), lambda x: x["node"])
    return got.select(
        "g", "b", "parts", F.sha2(_join(F.col("run.node")), 256).alias("node"),
        F.concat("steps", F.array(F.struct((F.col("mine") % fanout).cast("int").alias("place"), others.alias("others")))).alias("steps"))


def prove(items: DataFrame, fanout: int = 3, levels: int = LEVELS) -> DataFrame:
    """Tree root and inclusion proof of each item: its columns, ``top`` and ``proof``.

    ``items``: tree ``g`` (bigint), position ``i`` from 0, number ``total`` of items of the tree,
    ``leaf``, and other columns. Every ``fanout ** levels`` consecutive leaves are one
    partition, so a tree with a third of all rows is many partitions. Partitions build their
    lowest levels alone, then exchange roots round by round (``_round``) and hash the ancestors
    redundantly: after the last round each holds its whole upper proof, and no pass goes down
    the tree again. ``proof``: from the leaf up, place among the run and digests of the others.
    """
    block = fanout ** levels
    own = [c for c in items.columns if c not in ("g", "total")]
    b = F.floor(F.col("i") / block).cast("bigint")
    gathered = items.groupBy("g", "total", b.alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", *[c for c in own if c != "i"]))).alias("rows"))
    parts = F.ceil(F.col("total") / block).cast("bigint")
    blocks = materialize(gathered.select(
        "g", "b", parts.alias("parts"), "rows", let(F.col("rows.leaf"), lambda x: _levels(x, parts > 1, levels, fanout)).alias("levels")))
    step = "array<struct<place:int,others:array<string>>>"
    state = blocks.select("g", "b", "parts", F.element_at(F.element_at("levels", -1), 1).alias("node"), F.array().cast(step).alias("steps"))
    most = blocks.agg(F.max("parts")).first()[0] or 0
    done, width = [state.filter("parts <= 1")], 1
    while width < most:
        state = materialize(_round(state.filter(F.col("parts") > width), width, fanout))
        width *= fanout
        done.append(state.filter(F.col("parts") <= width))
    upper = reduce(DataFrame.unionByName, done).select("g", "b", F.col("node").alias("top"), "steps")
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    proved = F.transform(places, lambda k: F.struct(
        F.get("rows", k).alias("row"), F.concat(_steps(F.col("levels"), k, fanout), F.col("steps")).alias("proof")))
    return blocks.join(upper, ["g", "b"]).select("g", "top", F.inline(proved)).select("g", "row.*", "top", "proof")


def manifest(
    docs: DataFrame, fields: Sequence[str], group: str = "source", key: str = "doc_id", fanout: int = 3,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaf, subroot, root and proof of each row: ``key``, ``group``, leaf, subroot, root, proof and ``carry``.

    A row's leaf is the digest of ``fields``. Leaves of a group ascend by key (null first; rows
    of one key by leaf, repeated rows are leaves of their own); runs of ``fanout`` nodes become
    their hash until one node is left, the subroot. Groups in byte order (null first) form the
    tree of subroots in the same way. Other columns of ``docs`` are not read. Null and empty
    fields differ in the digest. An empty table gives no rows. Texts are hashed where they are
    scanned; only digests are sorted and exchanged.
    """
    carry = carry or {}
    rows = materialize(docs.select(
        F.col(f"`{group}`").alias("_group"), F.col(f"`{key}`").alias("_key"), digest([F.col(f"`{f}`") for f in fields]).alias("leaf"),
        F.struct(F.lit(0).alias("_none"), *[c.alias(n) for n, c in carry.items()]).alias("_carry")))
    placed = number_rows(rows, [F.col("_group").asc_nulls_first(), F.col("_key").asc_nulls_first(), F.col("leaf")], "_n")
    groups = placed.groupBy("_group").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("total"))
    groups = materialize(number_rows(groups, ["_first"], "_g").withColumnRenamed("_group", "_name"))
    items = placed.join(small(groups), F.col("_group").eqNullSafe(F.col("_name"))).select(
        (F.col("_g") - 1).alias("g"), (F.col("_n") - F.col("_first")).alias("i"), "total", "leaf", "_group", "_key", "_carry")
    leaves = materialize(prove(items, fanout))
    tops = leaves.filter("i = 0").select(
        F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.lit(groups.count()).cast("bigint").alias("total"), F.col("top").alias("leaf"))
    roots = materialize(prove(tops, fanout)).select(F.col("i").alias("g"), F.col("top").alias("root"), F.col("proof").alias("_upper"))
    return leaves.join(small(roots), "g").select(
        F.col("_key").alias(key), F.col("_group").alias(group), "leaf", F.col("top").alias("subroot"), "root",
        F.concat("proof", "_upper").alias("proof"), *[F.col(f"_carry.`{n}`").alias(n) for n in carry])


def fold(leaf: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its proof."""
    def up(node: Column, step: Column) -> Column:
        others = step["others"]
        return F.sha2(F.concat(_join(F.slice(others, 1, step["place"])), node, _join(F.slice(others, step["place"] + 1, F.size(others)))), 256)

    return F.aggregate(proof, leaf, up)
