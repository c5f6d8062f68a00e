"""Reply trees: enumerate root-to-leaf paths, rank the branches, format conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.columns import let, running
from tablescope.session import materialize

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"

#: Escapes, applied in this order and undone backwards. No escaped text holds ``<`` or ``#``.
_ESCAPES = (("~", "~0"), ("<", "~1"), ("#", "~2"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "~3"))


def escape(value: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, coded in pairs:
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def unescape(value: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        value = F.replace(value, F.lit(coded), F.lit(plain))
    return value


def reply_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, path, score).

    ``nodes`` has tree, node, parent, score; (tree, node) is unique. Every node starts as
    the piece that holds itself; a self-join puts the piece that ends at a piece's parent
    before it, which doubles the pieces, so the rounds grow with the logarithm of the
    depth. A null parent or one that is not in the table makes a root. Nodes on a cycle
    have no root: a round in which no piece gets complete ends the search, and they give
    no path. ``score`` is the mean over the path, null scores count as 0. A node with many
    replies is a large key on one side of the join only, which the skew join splits.
    """
    known = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    inner = known.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    pieces = materialize(known.join(inner.withColumn("inner", F.lit(True)), ["tree", "node"], "left").select(
        "tree", "node", F.col("parent").alias("top"), F.array("node").alias("path"), F.col("score").alias("total"),
        F.col("inner").isNull().alias("leaf")))
    left = pieces.filter("top IS NOT NULL").count()
    while left:
        above = pieces.select("tree", F.col("node").alias("top"), F.col("top").alias("next"),
                              F.col("path").alias("head"), F.col("total").alias("head_total"))
        open_, done = pieces.filter("top IS NOT NULL"), pieces.filter("top IS NULL")
        grown = open_.join(above, ["tree", "top"], "left").select(
            "tree", "node", F.col("next").alias("top"),
            F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"),
            (F.col("total") + F.coalesce("head_total", F.lit(0.0))).alias("total"), "leaf")
        pieces = materialize(done.unionByName(grown))
        now = pieces.filter("top IS NOT NULL").count()
        if now == left:
            break
        left = now
    return pieces.filter("top IS NULL AND leaf").select(
        "tree", F.col("node").alias("leaf"), "path", (F.col("total") / F.size("path")).alias("score"))


def best_branches(paths: DataFrame, top: int) -> DataFrame:
    """The ``top`` paths of each tree by score, ties by leaf, with their ``rank`` from 1.

    A tree with very many leaves is ranked in 64 parts first; only the best of each part
    meet in one group.
    """
    order = [F.col("score").desc(), F.col("leaf")]
    part = F.pmod(F.xxhash64("leaf"), F.lit(64))
    few = paths.withColumn("_part", part).withColumn("rank", F.row_number().over(W.partitionBy("tree", "_part").orderBy(*order)))
    few = few.filter(F.col("rank") <= top).drop("_part")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(*order))).filter(F.col("rank") <= top)


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, leaf, score, formatted, loss_mask) per path.

    A turn is ``### role: text</turn>`` and a line feed, with role and text escaped, so no
    text can imitate a mark. ``loss_mask`` holds (start, end) of each assistant text in
    ``formatted``, in code points, the end exclusive. Null roles and texts count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = paths.select("tree", "leaf", "score", F.posexplode("path").alias("at", "node")).join(
        nodes.select("tree", "node", role.alias("role"), escape(text).alias("body"),
                     F.concat(F.lit(OPEN), escape(role, _ROLE_ESCAPES), F.lit(COLON)).alias("head")), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))

    def masks(t: Column) -> Column:
        lengths = F.transform(t, lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE))
        starts = running(lengths, lambda total, x: total + x, F.lit(0))
        spans = F.zip_with(t, starts, lambda x, s: F.when(x["role"] == "assistant", F.struct(
            (s + F.length(x["head"])).alias("start"), (s + F.length(x["head"]) + F.length(x["body"])).alias("end"))))
        return F.filter(spans, lambda s: s.isNotNull())

    return whole.select(
        "tree", "leaf", "score",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        let(F.col("turns"), masks).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(OPEN) + 1, F.length(part)), COLON, 1)
        return let(role, lambda r: F.struct(
            unescape(r, _ROLE_ESCAPES).alias("role"),
            unescape(F.substring(part, len(OPEN) + F.length(r) + len(COLON) + 1, F.length(part))).alias("text")))

    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations without branches: each row answers the row before it.

    Rows go by turn, ties and null turns (first) by role and text; equal rows are all kept.
    A null conversation id is a conversation of its own.
    """
    by = W.partitionBy(conv).orderBy(F.col(turn), F.col(role), F.col(text))
    return rows.select(
        F.struct(F.col(conv).alias("id")).alias("tree"), F.row_number().over(by).cast("long").alias("node"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.lit(None).cast("double").alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def format_trees(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """Conversations of the ``top`` branches of each tree (None: all), see ``format_paths``.

    ``nodes`` has tree, node, parent, role, text, score; further columns are left out. An
    empty table gives no conversation.
    """
    paths = reply_paths(nodes)
    return format_paths(paths if top is None else best_branches(paths, top), nodes)
