"""Work of one task stays bounded however much a sheet or a table holds."""

import math
from collections import Counter

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.catalog import lineage as Q
from tablescope.operators import lineage as G
from tablescope.operators import ordering as O
from tablescope.sources import workbook as B


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cell_table(spark, rows, cols=3):
    body = spark.range(rows + 1).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    return body.select(
        F.lit("book").alias("path"), F.lit("S").alias("sheet"), "row", "col", G.to_address(F.col("row"), F.col("col")).alias("address"),
        F.when(F.col("row") == 0, F.concat(F.lit("h"), "col")).otherwise((F.col("row") * 10 + F.col("col")).cast("string")).alias("value"),
        F.lit(None).cast("string").alias("formula"), F.when(F.col("row") == 0, "s").otherwise("n").alias("kind"))


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_EDGES", 20)
    made = [("S", f"A{r}", None) for r in range(1, 41)] + [("S", f"B{r}", f"=SUM(A1:A{r})+A1+S!A{r}") for r in range(1, 41)]
    made += [("S", "B3", "=A1+Missing!A1+ZZ9")]  # a cell twice
    edges = G.formula_dependencies(spark.createDataFrame(made, "sheet string, address string, formula string"))
    want = sorted((f"S!B{r}", f"S!A{i}") for r in range(1, 41) for i in range(1, r + 1))
    assert sorted(map(tuple, edges.collect())) == want
    per_task = Counter(r[0] for r in edges.select(F.spark_partition_id()).collect())
    assert edges.rdd.getNumPartitions() >= len(want) // 20 and max(per_task.values()) < 60
    plan = plan_of(G.dependents_of(edges, spark.createDataFrame([("S!A40",)], "cell string")))
    assert "SortMergeJoin" not in plan
    assert [tuple(r) for r in G.dependents_of(edges, spark.createDataFrame([("S!A40",)] * 2, "cell string")).select("cell", "depends_on").collect()] == [("S!B40", "S!A40")]


def test_edges_of_no_formula(spark):
    cells = spark.createDataFrame([("S", "A1", None)], "sheet string, address string, formula string")
    assert G.formula_dependencies(cells).count() == 0


def test_typed_rows_are_dealt_by_cells(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_CELLS", 50, raising=False)
    table = B.typed_sheet(cell_table(spark, 100), "book", "S")
    assert table.rdd.getNumPartitions() == math.ceil((100 + 300) / 50)
    assert sorted(map(tuple, table.collect())) == [(r, r * 10, r * 10 + 1, r * 10 + 2) for r in range(1, 101)]


def test_column_catalog_sorts_no_cells(spark):
    columns = B.sheet_columns(cell_table(spark, 100))
    for names in columns, columns.select("name"):
        lowest = [line for line in plan_of(names).splitlines() if "Aggregate" in line][-1]
        assert "HashAggregate" in lowest and "ObjectHash" not in lowest
    assert [tuple(r) for r in columns.select("name", "inferred_type", "missing_count", "row_count").orderBy("col").collect()] == [
        (f"h{i}", "bigint", 0, 100) for i in range(3)]


def test_sheets_are_numbered_without_a_task_per_sheet(spark, sf):
    assert "Window" not in plan_of(Q._sheets(spark, sf))
    rows = spark.range(500).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "b").otherwise("a").alias("g"), F.xxhash64("id").alias("k"))
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("k")))
    assert sorted(map(str, O.number_within(rows, "g", ["k"], "n").collect())) == sorted(map(str, want.collect()))
