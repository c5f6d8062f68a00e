"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True where the row belongs to the held-out fold (remainder 2); false for a null id."""
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


def running(values: Column, step: Callable[[Column, Column], Column], start: Column, chunk: int = 256) -> Column:
    """State before each element when ``step(state, element)`` folds the array from ``start`` on.

    The states of a chunk are gathered apart from those of the chunks, so a long array
    costs its length times the chunk, not its length squared.
    """

    def states(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda k: F.slice(v, k * chunk + 1, chunk))

        def joined(p: Column) -> Column:
            heads = F.aggregate(p, F.array(start), lambda out, part: F.concat(
                out, F.array(F.aggregate(part, F.element_at(out, -1), step))))
            return let(heads, lambda h: F.flatten(F.transform(p, lambda part, k: F.slice(
                states(F.get(h, k), part), 1, F.size(part)))))

        return let(parts, joined)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.slice(F.array(start), 1, 0))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch for the jobs that run inside; set back afterwards.

    For functions that return long arrays: memory of a Python worker grows with its batch.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
