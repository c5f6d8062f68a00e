"""Levels and reach by buckets, and ranges kept as blocks, against plain graph walks."""

import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import lineage as G
from tablescope.operators import peel as P


def walk_levels(edges, cells):
    """Longest paths by repeated sweeps; None on or behind a cycle."""
    reads = {c: {u for a, u in edges if a == c and u in cells} for c in cells}
    level = {}
    while True:
        ready = [c for c in cells if c not in level and all(u in level for u in reads[c])]
        if not ready:
            return {c: level.get(c) for c in cells}
        for c in ready:
            level[c] = 1 + max((level[u] for u in reads[c]), default=-1)


def walk_reach(edges, start):
    hit, grown = set(start), True
    while grown:
        more = {c for c, u in edges if u in hit} - hit
        hit, grown = hit | more, bool(more)
    return hit


def graph(kind):
    rng = random.Random(kind)
    if kind == "random":  # several sheets, cycles, wide cells
        cells = [f"S{s}!A{r}" for s in range(4) for r in range(1, 60)]
        edges = {(c, rng.choice(cells[:max(1, i)])) for i, c in enumerate(cells) for _ in range(rng.randrange(4))} - {(c, c) for c in cells}
        edges |= {("S1!A5", "S2!A9"), ("S2!A9", "S1!A5"), ("S0!A1", "V!B2"), ("S3!A59", "V!B3")} | {("S3!A58", c) for c in cells[:150]}
        return edges, cells
    if kind == "carried":  # each sheet reads the one before: many crossings between buckets
        cells = [f"T{s}!{c}1" for s in range(40) for c in "AB"]
        edges = {(f"T{s}!A1", f"T{s - 1}!A1") for s in range(1, 40)} | {(f"T{s}!B1", f"T{t}!A1") for s in range(40) for t in (s, max(0, s - 7))}
        return edges, cells
    cells = [f"D!{c}{r}" for r in range(1, 1300) for c in "PQ"]  # deep: two columns that read each other's row above
    return {(f"D!P{r}", f"D!{c}{r - 1}") for r in range(2, 1300) for c in "PQ"} | {(f"D!Q{r}", f"D!P{r}") for r in range(1, 1300)}, cells


@pytest.mark.parametrize("kind,size,turns", [("random", 12, 6), ("random", 10**6, 6), ("carried", 5, 2), ("deep", 700, 6), ("random", 12, 1)])
def test_buckets_match_plain_walks(spark, monkeypatch, kind, size, turns):
    monkeypatch.setattr(P, "BUCKET_EDGES", size)
    monkeypatch.setattr(P, "CELL_EDGES", max(4, size // 3))
    monkeypatch.setattr(G, "_TURNS", turns)
    edges, cells = graph(kind)
    e = spark.createDataFrame(sorted(edges), "cell string, depends_on string")
    got = {r["cell"]: r["level"] for r in G.recalc_levels(e, spark.createDataFrame([(c,) for c in cells], "cell string")).collect()}
    assert got == walk_levels(edges, set(cells))
    start = [cells[0], cells[len(cells) // 2], "none!A1"]
    hit = {r["cell"] for r in G.affected_cells(e, spark.createDataFrame([(c,) for c in start], "cell string")).collect()}
    assert hit == walk_reach(edges, start)


def test_written_rows_follow_edges_not_depth(spark, monkeypatch):
    """Sheets of two columns that read the row above: the rows written per edge do not grow with the depth."""
    written = []
    plain = P.materialize

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(P, "materialize", counted)
    ratios = []
    for depth in (20, 400):
        rows = spark.range(8000 // depth).withColumnRenamed("id", "s").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(depth))))
        at = lambda c, r: F.concat(F.lit("S"), F.col("s").cast("string"), F.lit(f"!{c}"), r.cast("string"))
        r = F.col("r")
        pairs = F.array(*[F.struct(at(a, r).alias("cell"), at(b, q).alias("depends_on")) for a, b, q in (("P", "P", r - 1), ("P", "Q", r - 1), ("Q", "P", r))])
        edges = rows.select(F.inline(pairs))
        cells = rows.select(F.explode(F.array(at("P", r), at("Q", r))).alias("cell"))
        edges = edges.join(cells.withColumnRenamed("cell", "depends_on"), "depends_on", "left_semi")
        written.clear()
        levels = G.recalc_levels(edges, cells)
        assert levels.agg(F.max("level")).first()[0] == 2 * depth - 1
        ratios.append(sum(written) / edges.count())
    assert ratios[1] < 1.2 * ratios[0] and ratios[1] < 3


def test_pieces_cover_a_range_once(spark):
    ranges = [(0, 0), (0, 31), (5, 40), (0, 1023), (1, 1024), (7, 100_000), (0, 1_048_575), (31, 32)]
    df = spark.createDataFrame(ranges, "a long, b long")
    for r in df.select("a", "b", G._pieces(F.col("a"), F.col("b")).alias("p")).collect():
        spans = sorted((p.place * G.BLOCK**p.size, (p.place + 1) * G.BLOCK**p.size) for p in r.p)
        assert spans[0][0] == r.a and spans[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= 4 * 62
    assert len(df.filter("b = 1048575").select(G._pieces(F.col("a"), F.col("b")).alias("p")).first().p) == 1


def cell_table(spark, rows):
    return spark.createDataFrame(rows, "sheet string, address string, formula string, value string")


def test_long_ranges_are_blocks_and_give_the_same_levels(spark):
    rng = random.Random(5)
    rows = [("S", f"A{r}", None, "1") for r in range(1, 2200)]
    rows += [("S", f"B{r}", f"=A{r}*2" if r % 3 else f"=B{max(1, r - 1)}+1" if r > 1 else "=A1", None) for r in range(1, 300)]
    for i in range(1, 30):
        a, b = sorted((rng.randrange(1, 2300), rng.randrange(1, 2300)))
        rows.append(("T", f"C{i}", f"=SUM(S!{rng.choice('AB')}{a}:B{b})", None))
    rows += [("T", "D1", "=SUM(C1:C29)+D2", None), ("T", "E1", "=SUM(E1:E40)", None), ("T", "F1", "=MAX(S!A1:S!B900)+E1", None), ("S", "B2000", "=SUM(B100:B1999)", None)]
    cells = cell_table(spark, rows)
    edges, short = G.formula_dependencies(cells).cache(), G.formula_graph(cells).cache()
    assert short.count() < edges.count() / 4
    formulas = cells.filter("formula IS NOT NULL").select(G.cell_key(F.col("sheet"), F.col("address")).alias("cell"))
    levels = {r["cell"]: r["level"] for r in G.recalc_levels(short, formulas).collect()}
    assert levels == {r["cell"]: r["level"] for r in G.recalc_levels(edges, formulas).collect()}
    assert levels == walk_levels({tuple(r) for r in edges.collect()}, {r["cell"] for r in formulas.collect()})
    assert levels["T!E1"] is None and levels["T!C1"] is not None
    for start in (["S!A1500"], ["S!B20", "S!A7"], ["T!C3"], ["S!B2000"]):
        changed = spark.createDataFrame([(c,) for c in start], "cell string")
        assert {r["cell"] for r in G.affected_cells(short, changed).collect()} == walk_reach({tuple(r) for r in edges.collect()}, start)


def test_a_range_over_a_whole_sheet_costs_blocks(spark):
    rows = [("S", f"{c}{r}", None, "1") for r in (1, 500, 70_000, 1_048_576) for c in "AMZ"] + [("S", "AB1", "=SUM(A1:Z1048576)", None), ("S", "AC1", "=AB1", None)]
    short = G.formula_graph(cell_table(spark, rows)).cache()
    assert short.count() < 26 + 12 * 5 + 2
    hit = G.affected_cells(short, spark.createDataFrame([("S!M70000",)], "cell string"))
    assert {r["cell"] for r in hit.collect()} == {"S!M70000", "S!AB1", "S!AC1"}
