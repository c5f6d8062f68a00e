"""Intermediate tables that have been used up are removed."""

import os

from pyspark.sql import functions as F

from tablescope import session as S
from tablescope.plans import workflows as W
from tablescope.plans.roles import PrepSpec, Roles


def steps(path):
    return [n for n in os.listdir(path) if n.startswith("step-")]


def lines(spark):
    return spark.range(400).select("id", (F.col("id") % 37 / 5).alias("a"), (F.col("id") % 11 / 2).alias("b"), F.when(F.col("id") % 37 > 20, "hi").otherwise("lo").alias("y"))


def test_a_split_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_folder", lambda s: str(tmp_path))
    ready, _, _ = W.split_and_fit_preprocessor(lines(spark), Roles(("a", "b"), "y", "id"), PrepSpec(), "classification", ["id"], {})
    assert ready.count() == 400 and len(steps(tmp_path)) == 1


def test_prepare_holds_few_tables_at_a_time(spark, tmp_path, monkeypatch):
    """Tables as long as the input: never more than three at once outside DBSCAN, and only the result in the end."""
    monkeypatch.setattr(S, "shared_folder", lambda s: str(tmp_path))
    keep, most = W.settled, []

    def settled(make):
        out = keep(make)
        most.append(sum(spark.read.parquet(str(tmp_path / n)).count() == 400 for n in steps(tmp_path)))
        return out

    monkeypatch.setattr(W, "settled", settled)
    out = W.prepare(lines(spark), Roles(("a", "b"), "y", "id"), PrepSpec(), "linear_regression", ["id"])
    assert out.rows.count() == 400 and max(most) <= 3
    assert sum(spark.read.parquet(str(tmp_path / n)).count() == 400 for n in steps(tmp_path)) == 1


def test_settled_keeps_what_the_outer_one_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_folder", lambda s: str(tmp_path))
    inner = []

    def outer():
        inner.append(S.settled(lambda: S.materialize(spark.range(5)).filter("id > 1")))
        assert len(steps(tmp_path)) == 1
        return inner[0].filter("id > 2")

    assert S.settled(outer).count() == 2 and len(steps(tmp_path)) == 1
