"""Secret scan: known patterns plus sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.columns import let, running

# The patterns of the base scan and the least length of a match (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,rank:int,end:int>"

#: Strings that the entropy scan looks at, and the window it slides over them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20

#: Candidates that look random but are not secrets.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    r"^[0-9+/_=-]+$",  # no letter
    r"^[A-Za-z+/_=-]+$",  # no digit
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]?(?:key|token|secret)|xxxx|0123456789|abcdefgh",
    r"^(?:[A-Za-z]*[/_-])*[A-Za-z]+[/_-][0-9]{1,6}$",  # path or slug that ends in a number
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidates made of ``pattern`` need a window of ``bits`` bits per character."""

    name: str
    pattern: str
    bits: float


#: The first class whose pattern fits decides. A window of 20 has at most log2(20) = 4.32 bits.
CLASSES = (
    EntropyClass("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9),
    EntropyClass("upper", r"^[A-Z0-9=]+$", 3.4),
    EntropyClass("alnum", r"^[A-Za-z0-9]+$", 3.6),
    EntropyClass("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)


def _placed(text: Column, pattern: str, build) -> Column:
    """``build(match, start)`` per match, in order; offsets in code points.

    Offsets are running sums of the lengths of matches and of the parts between them, so
    no match is searched for again.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda x: F.length(x))

        def spans(g: Column) -> Column:
            lengths = F.zip_with(g, m, lambda a, b: a + F.length(b))
            before = running(lengths, lambda total, x: total + x, F.lit(0))
            return F.zip_with(m, F.zip_with(before, g, lambda a, b: a + b), build)

        return let(gaps, spans)

    return let(found, place)


def _span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _whole(text: Column, pattern: str, rank: int) -> Column:
    return _placed(text, pattern, lambda m, start: _span(start, rank, start + F.length(m)))


def _assignments(text: Column) -> Column:
    """Matches too short after the sign use up their text and are dropped."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.arrays_zip(_whole(text, ASSIGN, 0).alias("span"), values.alias("value"))
    long = F.filter(both, lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return F.transform(long, lambda x: x["span"])


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end) of the three base kinds; ``text`` must not be null."""
    lower = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(lower, F.lit(word))
    return F.concat(
        F.when(named, _assignments(text)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _whole(text, ACCESS, 1)).otherwise(_none()),
        F.when(text.rlike("[0-9a-f]{16}"), _whole(text, HEX, 2)).otherwise(_none()),
    )


def dense_part(candidate: Column, bits: Column) -> Column:
    """(first, last) offsets that windows of at least ``bits`` bits per character cover.

    The sum of c * log2(c) over the character counts of the window is carried along: the
    character that leaves and the one that enters change one count each. Null offsets mean
    that no window qualifies.
    """
    terms = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 1)])
    state = "struct<sum:double,first:int,last:int>"

    def scan(chars: Column) -> Column:
        def count(of: Column, start: Column, length: Column) -> Column:
            return F.size(F.filter(F.slice(chars, start + 1, length), lambda y: y == of))

        def move(acc: Column, i: Column) -> Column:
            held = F.least(i, F.lit(WINDOW - 1))
            entering = let(count(F.get(chars, i), i - held, held), lambda k: F.get(terms, k + 1) - F.get(terms, k))
            leaving = F.when(i >= WINDOW, let(
                count(F.get(chars, i - WINDOW), i - WINDOW, F.lit(WINDOW)), lambda k: F.get(terms, k - 1) - F.get(terms, k)
            )).otherwise(F.lit(0.0))
            return let(acc["sum"] + entering + leaving, lambda s: let(
                (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - s / WINDOW >= bits),
                lambda dense: F.struct(
                    s.alias("sum"),
                    F.when(dense, F.coalesce(acc["first"], i - (WINDOW - 1))).otherwise(acc["first"]).alias("first"),
                    F.when(dense, i + 1).otherwise(acc["last"]).alias("last"),
                )))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1),
                           F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"),
                                    F.lit(None).cast("int").alias("last")).cast(state), move)

    return let(F.split(candidate, ""), scan)


def entropy_spans(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Array of (start, rank, end) of dense parts of candidate strings that are not allowed."""
    bits = F.lit(None).cast("double")

    def limit(candidate: Column) -> Column:
        out = bits
        for c in reversed(classes):
            out = F.when(candidate.rlike(c.pattern), F.lit(c.bits)).otherwise(out)
        for pattern in allowed:
            out = F.when(candidate.rlike(pattern), F.lit(None).cast("double")).otherwise(out)
        return out

    def build(candidate: Column, start: Column) -> Column:
        return let(limit(candidate), lambda b: F.when(b.isNotNull(), let(dense_part(candidate, b), lambda p: F.when(
            p["first"].isNotNull(), _span(start + p["first"], 3, start + p["last"])))))

    spans = F.filter(_placed(text, CANDIDATE, build), lambda x: x.isNotNull())
    return F.when(text.rlike(CANDIDATE), spans).otherwise(_none())


def find_secrets(docs: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end), sorted.

    Offsets are code points, the end exclusive; ``rank`` indexes KINDS. An entropy span
    inside a base span is not repeated; base spans are never suppressed. Null text counts
    as empty and has no spans. Every row is scanned whole and by itself: no shuffle, and
    copies get equal spans. Columns named base or spans are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("base", F.array_sort(base_spans(value))).withColumn("_dense", entropy_spans(value, classes, allowed)).withColumn(
        "spans", F.when(F.size("_dense") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", F.filter("_dense", lambda x: ~F.exists(
            F.col("base"), lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))))),
    ).drop("_dense")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined; empty text for no spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``spans`` replaced by ``mask``; overlapping spans become one.

    Texts without spans stay as they are, null included.
    """
    value = F.col(text)

    def rebuilt(spans: Column) -> Column:
        ends = running(spans, lambda end, s: F.greatest(end, s["end"]), F.lit(0))
        pieces = F.zip_with(spans, ends, lambda s, end: F.when(s["start"] >= end, F.concat(
            F.substring(value, end + 1, s["start"] - end), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring(value, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(value)))

    return docs.withColumn(text, F.when(F.size("spans") > 0, rebuilt(F.col("spans"))).otherwise(value))
