"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.columns import let, words
from tablescope.session import materialize

#: Words in a window; ``_repeated`` doubles up to this length.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean Column over the text and the base measures; null counts as false."""

    name: str
    rejects: Column


def _pairs(values: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on; ``step`` elements shorter."""
    rest = F.size(values) - step
    return F.zip_with(F.slice(values, 1, rest), F.slice(values, 1 + step, rest), lambda a, b: F.xxhash64(a, b))


def _repeated(w: Column) -> Column:
    """Positions covered by windows of 8 words that occur at least twice.

    Window hashes come from doubling: pairs of words, of pairs, of fours. Texts without a
    repeated window leave after one ``array_distinct``; for the others the windows are
    sorted by hash, the positions of equal neighbours are sorted again and their union is
    summed up.
    """

    def covered(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), last), lambda k: (
                ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == F.get(s, k)["h"]))
                | ((k < last) & (F.get(s, F.least(k + 1, last))["h"] == F.get(s, k)["h"]))))
            return F.array_sort(F.transform(at, lambda k: F.get(s, k)["i"]))

        total = F.aggregate(
            let(by_hash, positions),
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["total"] + p + WINDOW - F.greatest(p, acc["end"])).alias("total"), (p + WINDOW).alias("end")),
            lambda acc: acc["total"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def eights(two: Column) -> Column:
        return let(_pairs(two, 2), lambda four: let(_pairs(four, 4), covered))

    return F.when(F.size(w) >= WINDOW, let(_pairs(w, 1), eights)).otherwise(F.lit(0))


def _stutter(w: Column) -> Column:
    """Words equal to the word before them."""
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: a == b), lambda same: same))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter (long).

    Null text counts as empty: all measures are 0. Lines are counted if they hold a word.
    Columns of the same names in ``docs`` are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    without = value
    for symbol in SYMBOLS:
        without = F.replace(without, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    from_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).cast("long").alias("n_repeat_words"),
        _stutter(w).cast("long").alias("n_stutter"),
    ))
    from_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    return docs.withColumns({
        "_words": from_words, "_lines": from_lines, "n_symbols": (F.length(value) - F.length(without)).cast("long"),
    }).withColumns({
        "n_words": F.col("_words.n_words"), "word_chars": F.col("_words.word_chars"),
        "n_repeat_words": F.col("_words.n_repeat_words"), "n_stutter": F.col("_words.n_stutter"),
        "n_lines": F.col("_lines.n_lines"), "n_dup_lines": F.col("_lines.n_dup_lines"),
    }).drop("_words", "_lines")


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules of the cascade; they refer to the columns of ``measure``."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 20 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("copied_lines", 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
        Rule("stutter", 100 * F.col("n_stutter") > 30 * F.col("n_words")),
        Rule("shouting", value.rlike(r"(?:\p{Lu}{2,}\P{L}+){12}")),
        Rule("long_word", value.rlike(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1000}")),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """``rules`` in the order of rejections per second among the rows that earlier rules left.

    The sample (about ``sample_rows`` rows, drawn over the whole table, without those the
    base rule rejects) fits the order only;
    every order gives the same verdicts. A rule's cost is the time of a pass that evaluates
    it alone, less the time of an empty pass. Rejections are counted per combination of
    rules, at most 2 to the number of rules. An empty table keeps the order.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    few = docs.sample(fraction=min(1.0, sample_rows / total), seed=seed)
    sample = materialize(measure(few, text).filter(~base_failed()))

    def seconds(flag: Column) -> float:
        start = time.perf_counter()
        sample.select(F.count_if(flag)).collect()
        return time.perf_counter() - start

    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"_r{i}") for i, r in enumerate(rules)]
    patterns = [(r[:-1], r[-1]) for r in sample.select(*flags).groupBy(*[f"_r{i}" for i in range(len(rules))]).count().collect()]
    empty = seconds(F.lit(False))
    cost = [max(seconds(r.rejects) - empty, 1e-4) for r in rules]
    order: list[int] = []
    while len(order) < len(rules):
        alive = [(p, n) for p, n in patterns if not any(p[i] for i in order)]
        rest = [i for i in range(len(rules)) if i not in order]
        order.append(max(rest, key=lambda i: (sum(n for p, n in alive if p[i]) / cost[i], -cost[i])))
    return [rules[i] for i in order]


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. Later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``rejected_by`` and ``kept``.

    The base rule stands first because its measures are part of the result. Null and empty
    texts fail it (no words). Rows are judged one by one: copies get equal verdicts, other
    columns pass through, an empty table gives an empty result. No shuffle.
    """
    rules = default_rules(text) if rules is None else rules
    ordered = order_rules(docs, rules, text, sample_rows)
    return measure(docs, text).withColumns({
        "base_failed": base_failed(),
        "rejected_by": F.when(base_failed(), F.lit("base")).otherwise(first_rejection(ordered)),
    }).withColumn("kept", F.col("rejected_by").isNull())
