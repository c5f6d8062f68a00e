"""URL filter: rules first, then the ratio of two character Markov models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.session import materialize

#: Longest context in characters, and the number of symbols a gram is written in.
ORDER = 4
BASE = 98
#: Grams shipped to the tasks at a time.
PART_GRAMS = 1_000_000
#: Characters the smoothing shares its rest over (printable ASCII and one for all others).
ALPHABET = 96


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, the first one of equal length; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def _symbols(text: str) -> np.ndarray:
    """Characters as 0 to 95, with ORDER starts before and an end mark (all outside ASCII are 95)."""
    raw = np.frombuffer(text.encode("ascii", "replace").replace(b"\x7f", b"?"), dtype=np.uint8).astype(np.uint64)
    raw = np.where(raw >= 32, raw - np.uint64(32), np.uint64(95))
    return np.concatenate([np.full(ORDER, 96, dtype=np.uint64), raw, np.array([97], dtype=np.uint64)])


def _grams(text: str) -> np.ndarray:
    """Each character with the ORDER before it as one number; modulo BASE ** (k + 1) it is the gram of order k."""
    s = _symbols(text).astype(np.int64)
    n = len(s) - ORDER
    return sum(s[ORDER - k:ORDER - k + n] * BASE ** k for k in range(ORDER + 1))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts per (label, gram)."""
    for b in batches:
        out = []
        for label, texts in b.groupby("label")["text"]:
            at, n = np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)
            out.append(pd.DataFrame({"label": label, "gram": at, "n": n}))
        yield pd.concat(out) if out else pd.DataFrame({"label": [], "gram": [], "n": []}).astype({"label": "int32", "gram": "int64", "n": "int64"})


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts (label, gram, n) of the longest grams over all rows of (label, text); grows with the input."""
    return labelled.select(F.col("label").cast("int").alias("label"), "text").mapInPandas(_count, "label int, gram long, n long").groupBy(
        "label", "gram").agg(F.sum("n").alias("n"))


def count_models(labelled: DataFrame) -> list[list[pd.Series]]:
    """Counts of both classes by gram, fetched: [label 0 or 1][order]. For tables known to
    be small; ``filter_urls`` leaves its counts distributed."""
    rows = count_grams(labelled).toPandas()
    own = [rows[rows["label"] == label].set_index("gram")["n"] for label in (0, 1)]
    return [[n.groupby(n.index % BASE ** (k + 1)).sum() for k in range(ORDER + 1)] for n in own]


def log_ratio(counts: list[list[pd.Series]], text: str) -> float:
    """Mean over the characters of log P(accepted) - log P(rejected).

    Each model interpolates from the uniform distribution up to the longest context; a
    context seen c times weighs c / (c + 2), so a context never seen leaves the shorter
    one's estimate as it is.
    """
    grams, logs = _grams(text), []
    for tables in counts:
        p = np.full(len(grams), 1.0 / (ALPHABET + 1))
        for k, n in enumerate(tables):
            own = grams % BASE ** (k + 1)
            seen = n.reindex(own, fill_value=0).to_numpy()
            c = n.groupby(n.index // BASE).sum().reindex(own // BASE, fill_value=0).to_numpy()
            p = (seen + 2.0 * p) / (c + 2.0)
        logs.append(np.log(p))
    return float(np.mean(logs[1] - logs[0]))


def gram_values(grams: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``gram`` with log P(accepted) - log P(rejected) of its last character as in ``log_ratio``,
    one column for each (rejected, accepted) pair of count columns.

    A gram has every shorter one within it, so each order is a grouping by the gram's end and
    is joined to the order below. A context has at most BASE grams, and an end at most BASE
    longer ones: no group is larger.
    """
    names = [n for pair in pairs.values() for n in pair]
    out = None
    for k in range(ORDER + 1):
        own = grams.groupBy((F.col("gram") % BASE ** (k + 1)).alias("gram")).agg(*[F.sum(n).alias(n) for n in names])
        context = Window.partitionBy(F.floor(F.col("gram") / BASE))
        own = own.withColumns({f"_c_{n}": F.sum(n).over(context) for n in names})
        if out is None:
            own = own.withColumns({f"_p_{n}": F.lit(1.0 / (ALPHABET + 1)) for n in names})
        else:
            own = own.withColumn("_end", F.col("gram") % BASE ** k).join(out.withColumnRenamed("gram", "_end"), "_end")
        out = own.select("gram", *[((F.col(n) + 2.0 * F.col(f"_p_{n}")) / (F.col(f"_c_{n}") + 2.0)).alias(f"_p_{n}") for n in names])
    return out.select("gram", *[(F.log(f"_p_{a}") - F.log(f"_p_{r}")).alias(name) for name, (r, a) in pairs.items()])


def _adder(shipped: Broadcast) -> Callable[[Column], Column]:
    """The share of the shipped grams in a text's mean value."""

    @F.pandas_udf("double")
    def add(texts: pd.Series) -> pd.Series:
        known, values = shipped.value
        if not len(texts):
            return pd.Series([], dtype="float64")
        grams = [_grams(t) for t in texts]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        flat = np.concatenate(grams)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        found = np.where(known[at] == flat, values[at], 0.0)
        return pd.Series(np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes)

    return add


def score_texts(df: DataFrame, values: DataFrame, value: str, part_grams: int = PART_GRAMS) -> DataFrame:
    """``df`` with score, the mean of ``value`` over the grams of ``_text``.

    The values are shipped in parts of about ``part_grams`` grams, each part adding its
    share; with more than one, rows are written between passes.
    """
    parts = max(1, -(-values.count() // part_grams))
    out = df.withColumn("score", F.lit(0.0))
    for k in range(parts):
        own = values.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).select("gram", value).toPandas().sort_values("gram")
        if not len(own):
            continue
        add = _adder(df.sparkSession.sparkContext.broadcast((own["gram"].to_numpy(), own[value].to_numpy())))
        out = out.withColumn("score", F.col("score") + add(F.col("_text")))
        out = materialize(out) if k < parts - 1 else out
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", miss: float = 0.05) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (allow or block).

    A row that a rule fits gets the rule's verdict. Rows with a rule are the accepted and
    rejected examples of the two models. The threshold, which blocks at most the share
    ``miss`` of accepted examples (see ``calibrate``), comes from a quarter of them (by a hash
    of the url) under models of the other three; the models are then counted over all of
    them. A row without a rule is allowed if its score reaches the threshold. The models read
    host and path. With examples of one kind only, or none, rows without a rule are allowed,
    score 0. Null urls have empty host and path and are scored as empty text. Rows are judged
    one by one, repeated rows get equal verdicts, columns of these names are replaced.
    """
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(
        "rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdicts = {r.name: r.allow for r in rules}
    by_rule = F.lit(None).cast("boolean")
    for name, allow in verdicts.items():
        by_rule = F.when(F.col("rule") == name, F.lit(allow)).otherwise(by_rule)
    parts = parts.withColumns({"_text": F.concat("host", "path"), "_allow": by_rule})
    # 0 and 1 count at once, 2 and 3 are held; rows without a rule (4) only name the grams to be valued.
    held = F.pmod(F.xxhash64("_text"), F.lit(4)) == 0
    kind = F.coalesce(F.col("_allow").cast("int") + F.when(held, 2).otherwise(0), F.lit(4))
    counted = materialize(count_grams(parts.select(kind.alias("label"), F.col("_text").alias("text"))))
    kinds = {r[0] for r in counted.select("label").distinct().collect()}
    if {k % 2 for k in kinds - {4}} != {0, 1}:
        return parts.withColumns({"score": F.lit(0.0), "verdict": F.when(F.coalesce("_allow", F.lit(True)), "allow").otherwise("block")}).drop("_text", "_allow")
    sums = {f"{name}{y}": F.sum(F.when(F.col("label").isin(*labels), F.col("n")).otherwise(0)) for y in (0, 1) for name, labels in (("most", [y]), ("all", [y, y + 2]))}
    grams = counted.groupBy("gram").agg(*[x.alias(n) for n, x in sums.items()])
    values = materialize(gram_values(materialize(grams), {"most": ("most0", "most1"), "all": ("all0", "all1")}))
    limit = 0.0
    if {0, 1} <= kinds:
        examples = parts.filter(F.col("_allow").isNotNull() & held).select(F.col("_allow").cast("int").alias("label"), "_text")
        limit = calibrate(score_texts(examples, values, "most").select("label", "score"), miss)
    return score_texts(parts, values, "all").withColumn("verdict", F.when(
        F.coalesce(F.col("_allow"), F.col("score") >= limit), "allow").otherwise("block")).drop("_text", "_allow")


def calibrate(scored: DataFrame, miss: float, bins: int = 2000, reach: float = 5.0) -> float:
    """Threshold below which at most the share ``miss`` of accepted rows lies.

    The largest such score; where at most that share of rejected rows lies above a lower
    score, the middle between the two. Scores are counted into ``bins`` steps between -reach
    and reach, so the driver gets at most 2 * bins rows. 0 without rows of both kinds.
    """
    step = F.floor((F.greatest(F.lit(-reach), F.least(F.lit(reach - 1e-9), F.col("score"))) + reach) / (2 * reach) * bins).cast("int")
    held = np.zeros((2, bins))
    for label, at, n in scored.groupBy("label", step.alias("at")).count().collect():
        held[label, at] += n
    if not held[0].sum() or not held[1].sum():
        return 0.0
    accepted_below = np.concatenate([[0.0], np.cumsum(held[1])]) / held[1].sum()
    rejected_from = 1 - np.concatenate([[0.0], np.cumsum(held[0])]) / held[0].sum()
    high = int(np.flatnonzero(accepted_below <= miss)[-1])
    low = int(np.flatnonzero(rejected_from <= miss)[0])
    return float(min(high, (high + low) / 2) / bins * 2 * reach - reach)
