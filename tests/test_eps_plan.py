"""Distances of an eps join are compiled with the join, and right."""

import numpy as np
from pyspark.sql import functions as F

from tablescope.operators import neighbors as N


def test_pairs_are_compared_by_compiled_code(spark):
    rows = spark.range(200).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)) / 97).alias(f"c{i}") for i in range(4)])
    out = N.eps_join(rows, ["c0", "c1", "c2", "c3"], 0.4, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "lambdafunction" not in plan
    x = np.array(rows.select("c0", "c1", "c2", "c3").collect())
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a, b = np.nonzero(np.triu(gap <= 0.4, 1))
    got = {(r["left"], r["right"]): r["distance"] for r in out.collect()}
    assert set(got) == set(zip(a.tolist(), b.tolist())) and all(abs(d - gap[p]) < 1e-12 for p, d in got.items())
