"""Formula lineage on cell tables: dependencies, affected cells, cycles, audit.

Cells are rows (sheet, address, formula, value); a cell's key is ``sheet!A1``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.peel import VIRTUAL, is_virtual, settle_levels, settle_reach
from tablescope.session import materialize

# Reference pattern, volatile functions and the functions a formula may call.
REFERENCE = (
    r"(?:'([^']+)'|([A-Za-z0-9_]+))!([A-Z]+[1-9][0-9]*(?::[A-Z]+[1-9][0-9]*)?)"
    r"|\b([A-Z]+[1-9][0-9]*(?::[A-Z]+[1-9][0-9]*)?)\b"
)
VOLATILE = ("TODAY", "NOW", "RAND", "RANDBETWEEN")
SUPPORTED = (
    "SUM", "AVERAGE", "MIN", "MAX", "COUNT", "IF", "AND", "OR", "NOT", "ROUND", "ABS",
    "INDEX", "MATCH", "VLOOKUP", "XLOOKUP",
    "CONCAT", "LEFT", "RIGHT", "MID", "LEN", "TRIM", "UPPER", "LOWER", "SUBSTITUTE",
    "DATE", "DATEVALUE", "YEAR", "MONTH", "DAY", "EDATE", "EOMONTH", "NETWORKDAYS", "TEXT",
    "TODAY", "NOW", "RAND", "RANDBETWEEN", "PREDICT",
)
_CALL = r"([A-Z][A-Z0-9_]*)\s*\("

TASK_EDGES = 500_000


def column_index(label: Column) -> Column:
    """A -> 0, Z -> 25, AA -> 26. Up to three letters by plain arithmetic, longer ones by a fold."""
    def letter(at: int) -> Column:
        return F.ascii(F.substring(label, at, 1)) - 64

    size = F.length(label)
    fold = F.aggregate(F.split(label, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64))
    return (
        F.when(size == 1, letter(1)).when(size == 2, letter(1) * 26 + letter(2)).when(size == 3, letter(1) * 676 + letter(2) * 26 + letter(3)).otherwise(fold)
    ) - 1


def column_label(index: Column) -> Column:
    """0 -> A, 26 -> AA, 702 -> AAA and on, up to seven letters (every 32-bit index)."""
    out, offset = F.lit(None).cast("string"), 0
    whens = []
    for length in range(1, 8):
        i = index.cast("long") - offset
        letters = [F.char(F.pmod(F.floor(i / F.lit(26**k)), F.lit(26)) + 65) for k in range(length - 1, -1, -1)]
        offset += 26**length
        whens.append((index < offset, F.concat(*letters)))
    for fits, label in reversed(whens):
        out = F.when(fits, label).otherwise(out)
    return out


def parse_address(address: Column) -> tuple[Column, Column]:
    """0-based (row, column); NULL for text that is no address."""
    text = F.upper(F.trim(address))
    ok = text.rlike(r"^[A-Z]+[1-9][0-9]*$")
    row = F.regexp_extract(text, r"([1-9][0-9]*)$", 1).try_cast("int") - 1
    return F.when(ok, row), F.when(ok, column_index(F.regexp_extract(text, r"^([A-Z]+)", 1)))


def to_address(row: Column, col: Column) -> Column:
    return F.concat(column_label(col), (row + 1).cast("string"))


def cell_key(sheet: Column, address: Column) -> Column:
    return F.concat(sheet, F.lit("!"), address)


def extract_formulas(cells: DataFrame) -> DataFrame:
    """Formula cells with a leading "=" and their cached value."""
    text = F.coalesce("formula", F.when(F.col("value").startswith("="), F.col("value")))
    found = cells.withColumn("formula", text).filter(F.col("formula").isNotNull())
    return found.withColumn("formula", F.when(F.col("formula").startswith("="), F.col("formula")).otherwise(F.concat(F.lit("="), "formula")))


def _place(ref: Column) -> tuple[Column, Column]:
    """0-based (row, column) of a reference known to be well formed; no pattern is run again."""
    letters = F.rtrim(ref, F.lit("0123456789"))
    return F.substring(ref, F.length(letters) + 1, F.length(ref)).try_cast("int") - 1, column_index(letters)


def _references(cells: DataFrame) -> DataFrame:
    """(cell, _sheet, _ref, _wide, r1, c1, r2, c2, _last): what each formula names, on known sheets and columns.

    ``_last`` is the last column of the sheet named; rows and columns count from 0.
    """
    widths = cells.groupBy(F.col("sheet").alias("_sheet")).agg(F.max(_place(F.col("address"))[1]).alias("_last"))
    formulas = cells.filter(F.col("formula").isNotNull())
    body = F.regexp_replace("formula", "^=", "")
    tokens = formulas.select(
        cell_key(F.col("sheet"), F.col("address")).alias("cell"), "sheet",
        F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(0)))).alias("t"),
    ).withColumn("_ref", F.substring_index("t", "!", -1))
    prefix = F.substring(F.col("t"), F.lit(1), F.length("t") - F.length("_ref") - 1)
    bare = F.when(prefix.startswith("'"), F.substring(prefix, F.lit(2), F.length(prefix) - 2)).otherwise(prefix)
    sheet = F.when(F.col("t").contains("!"), F.trim(bare)).otherwise(F.col("sheet"))
    (r1, c1), (r2, c2) = _place(F.substring_index("_ref", ":", 1)), _place(F.substring_index("_ref", ":", -1))
    parsed = tokens.select(
        "cell", sheet.alias("_sheet"), "_ref", F.col("_ref").contains(":").alias("_wide"), r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2")
    )
    # one row a sheet is hashed in each task; the references, however many, stream past it unsorted
    return parsed.join(widths.hint("shuffle_hash"), "_sheet").filter(F.least("c1", "c2") <= F.col("_last"))


def formula_dependencies(cells: DataFrame) -> DataFrame:
    """Edges (cell, depends_on). Ranges are expanded; unknown sheets and columns are ignored.

    One edge for each cell of each range: for a few cells, or where they are asked for. Long
    ranges have a short form, ``formula_graph``. Edges are counted first and dealt unfolded to tasks
    of about ``TASK_EDGES``, each of which keeps one of every copy.
    """
    known = materialize(_references(cells))
    rows = F.sequence(F.least("r1", "r2"), F.greatest("r1", "r2"))
    cols = F.sequence(F.least("c1", "c2"), F.least(F.greatest("c1", "c2"), F.col("_last")))
    # a single cell keeps its text; a range becomes rows first, then the columns of each row
    by_row = known.select("cell", "_sheet", "_ref", "_wide", cols.alias("_cols"), F.explode(F.when(F.col("_wide"), rows).otherwise(F.array("r1"))).alias("_r"))
    by_cell = by_row.select("cell", "_sheet", "_ref", "_wide", "_r", F.explode(F.when(F.col("_wide"), F.col("_cols")).otherwise(F.slice("_cols", 1, 1))).alias("_c"))
    at = F.when(F.col("_wide"), to_address(F.col("_r"), F.col("_c"))).otherwise(F.col("_ref"))
    spread = by_cell.select("cell", "_sheet", at.alias("at"))
    many = F.when(F.col("_wide"), (F.abs(F.col("r2") - F.col("r1")) + 1) * F.size(cols).cast("bigint")).otherwise(1)
    tasks = max(1, math.ceil((known.agg(F.sum(many)).first()[0] or 0) / TASK_EDGES))
    return spread.select("cell", cell_key(F.col("_sheet"), F.col("at")).alias("depends_on")).repartition(tasks, "cell", "depends_on").distinct()


#: Rows of a block, blocks of a larger block and so on, and how many sizes of blocks there are.
BLOCK, SIZES = 32, 5


def _pieces(first: Column, last: Column) -> Column:
    """The rows ``first`` .. ``last`` as few blocks: array of (size, place); size 0 is a row, size k a block of BLOCK ** k rows.

    At most 2 * (BLOCK - 1) pieces of each size but the largest, whatever the length.
    """
    piece, none = "array<struct<size:int,place:bigint>>", F.array().cast("array<bigint>")

    def run(a: Column, b: Column) -> Column:  # a .. b - 1
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def up(state: Column, size: Column) -> Column:
        """Take the rows (or blocks) that fill no block of the next size, go on with the blocks."""
        a, b = state["a"], state["b"]
        next_a, next_b = F.ceil(a / BLOCK).cast("bigint"), F.floor(b / BLOCK).cast("bigint")
        last_size = (size == SIZES) | (next_a >= next_b)
        places = F.when(last_size, run(a, b)).otherwise(F.concat(run(a, next_a * BLOCK), run(next_b * BLOCK, b)))
        taken = F.transform(places, lambda p: F.struct(size.alias("size"), p.alias("place")))
        return F.struct(
            F.concat(state["out"], taken.cast(piece)).alias("out"), F.when(last_size, F.lit(0).cast("bigint")).otherwise(next_a).alias("a"),
            F.when(last_size, F.lit(0).cast("bigint")).otherwise(next_b).alias("b"))

    start = F.struct(F.array().cast(piece).alias("out"), first.cast("bigint").alias("a"), (last.cast("bigint") + 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES)), start, up)["out"]


def _block_key(sheet: Column, col: Column, size: Column, place: Column) -> Column:
    """Key of a block of a column. The number at its end is its first row, as in a cell's key."""
    first = place * F.pow(F.lit(float(BLOCK)), size).cast("bigint")
    return F.concat(F.lit(VIRTUAL), sheet, F.lit("!"), column_label(col), F.lit("#"), size.cast("string"), F.lit("."), first.cast("string"))


def formula_graph(cells: DataFrame) -> DataFrame:
    """Edges (cell, depends_on, step) in which a long range is a few blocks of rows, not all its cells.

    A range reads, in each column, its whole blocks of 32, 1,024 .. rows and the single rows at
    its ends; a block reads the smaller blocks and cells in it that exist (``step`` 0: a block is no
    level of its own). ``=SUM(A1:Z1048576)`` is 26 edges, plus one edge to a block for each cell
    or block of those columns, shared by all ranges over them. Keys of blocks start
    with ``VIRTUAL``; ``affected_cells`` and ``recalc_levels`` give the same result from these edges
    as from those of ``formula_dependencies``.
    """
    known = materialize(_references(cells))
    single = known.filter(~F.col("_wide")).select("cell", cell_key(F.col("_sheet"), F.col("_ref")).alias("depends_on"))
    cols = F.sequence(F.least("c1", "c2"), F.least(F.greatest("c1", "c2"), F.col("_last")))
    spans = known.filter("_wide").select("cell", "_sheet", F.explode(_pieces(F.least("r1", "r2"), F.greatest("r1", "r2"))).alias("p"), cols.alias("_cols"))
    parts = materialize(spans.select("cell", "_sheet", "p.size", "p.place", F.explode("_cols").alias("_c")))
    row = cell_key(F.col("_sheet"), to_address(F.col("place"), F.col("_c")))
    block = _block_key(F.col("_sheet"), F.col("_c"), F.col("size"), F.col("place"))
    ranges = parts.select("cell", F.when(F.col("size") == 0, row).otherwise(block).alias("depends_on"))
    # the largest block read in each column says how far its cells are gathered
    used = parts.filter("size > 0").groupBy("_sheet", "_c").agg(F.max("size").alias("top"))
    at_row, at_col = _place(F.col("address"))
    placed = cells.select(F.col("sheet").alias("_sheet"), at_col.alias("_c"), at_row.cast("bigint").alias("r"), cell_key(F.col("sheet"), F.col("address")).alias("key"))
    held = placed.join(used, ["_sheet", "_c"])
    members = [held.select(_block_key(F.col("_sheet"), F.col("_c"), F.lit(1), F.floor(F.col("r") / BLOCK)).alias("cell"), F.col("key").alias("depends_on"))]
    for size in range(1, SIZES):
        inside = F.floor(F.col("r") / BLOCK**size)
        blocks = held.filter(F.col("top") > size).select("_sheet", "_c", inside.alias("place")).distinct()
        members.append(blocks.select(
            _block_key(F.col("_sheet"), F.col("_c"), F.lit(size + 1), F.floor(F.col("place") / BLOCK)).alias("cell"),
            _block_key(F.col("_sheet"), F.col("_c"), F.lit(size), F.col("place")).alias("depends_on")))
    direct = single.unionByName(ranges).distinct().withColumn("step", F.lit(1).cast("bigint"))
    gathered = reduce(DataFrame.unionByName, members).withColumn("step", F.lit(0).cast("bigint"))
    return direct.unionByName(gathered)


def dependents_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Direct dependents of the cells in ``keys`` (column ``cell``)."""
    asked = keys.select(F.col("cell").alias("depends_on")).distinct()
    return edges.join(asked.hint("shuffle_hash"), "depends_on", "left_semi")


def dependencies_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("cell").distinct(), "cell", "left_semi")


def replace_dependencies(edges: DataFrame, new_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after the cells in ``changed`` got new formulas (none left removes them)."""
    return edges.join(changed.select("cell").distinct(), "cell", "left_anti").unionByName(new_edges.select("cell", "depends_on"))


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split edges (cell, up, d) into cells with one dependency and the rest."""
    counted = edges.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.min("up").alias("up"), F.min("d").alias("d"))
    return counted.filter("k = 1").select("cell", "up", "d"), edges.join(counted.filter("k > 1").select("cell"), "cell", "left_semi")


def _jump(single: DataFrame) -> DataFrame:
    """Follow single-dependency chains by pointer doubling.

    ``single``: (cell, up, dist, flag). Pointers double per round, so a running total of
    a million rows takes twenty rounds. Each round settles the chains of twice the length
    and spreads flags twice as far; when neither count changes, the pointers still moving
    (``moved``) sit on or behind a cycle.
    """
    table = materialize(single.withColumn("moved", F.lit(True)))
    before = None
    while True:
        ahead = table.select(F.col("cell").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("flag").alias("_flag"))
        table = materialize(table.join(ahead, "up", "left").select(
            "cell", F.coalesce("_up", "up").alias("up"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            (F.col("flag") | F.coalesce("_flag", F.lit(False))).alias("flag"), F.col("_up").isNotNull().alias("moved"),
        ))
        state = tuple(table.agg(F.count_if("moved"), F.count_if("flag")).first())
        if state[0] == 0 or state == before:
            return table
        before = state


# Rounds after which long chains from bucket to bucket are contracted.
_TURNS = 6


def affected_cells(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed cells and everything that depends on them, directly or not.

    The graph is walked bucket by bucket (``peel``). If that takes many rounds, chains of single
    dependencies, such as totals carried from sheet to sheet, are contracted first. Takes the
    edges of ``formula_dependencies`` or ``formula_graph``.
    """
    start = materialize(changed.select("cell").distinct())
    edges = materialize(edges.select("cell", F.col("depends_on").alias("up"), F.lit(0).cast("bigint").alias("d")).distinct())
    found, all_ = settle_reach(edges, start, _TURNS)
    hit = start.unionByName(found).distinct()
    if not all_:
        hit = _affected_by_chains(edges, materialize(hit))
    return hit.filter(~is_virtual(F.col("cell")))


def _affected_by_chains(edges: DataFrame, start: DataFrame) -> DataFrame:
    mark = start.withColumn("_hit", F.lit(True))
    single, branching = _chains(edges)
    base = single.join(mark.withColumnRenamed("cell", "up"), "up", "left").select(
        "cell", "up", F.lit(1).cast("bigint").alias("dist"), F.coalesce("_hit", F.lit(False)).alias("flag")
    )
    chains = _jump(base).select("cell", "up", "flag")
    # contracted edges: a branching cell depends on the head of each chain it reads
    heads = chains.select(F.col("cell").alias("up"), F.col("up").alias("_head"), "flag")
    short = materialize(branching.join(heads, "up", "left").join(mark.withColumnRenamed("cell", "up"), "up", "left").select(
        "cell", F.coalesce("_head", "up").alias("up"), "d", (F.coalesce("flag", F.lit(False)) | F.coalesce("_hit", F.lit(False))).alias("flag"),
    ))
    seed = materialize(short.filter("flag").select("cell").unionByName(start).distinct())
    more, _ = settle_reach(materialize(short.select("cell", "up", "d").distinct()), seed)
    visited = materialize(seed.unionByName(more).distinct())
    by_head = chains.join(visited.withColumnRenamed("cell", "up"), "up", "left_semi").select("cell")
    return visited.unionByName(by_head).unionByName(chains.filter("flag").select("cell")).distinct()


def recalc_levels(edges: DataFrame, formulas: DataFrame) -> DataFrame:
    """(cell, level): 0 reads no formula, else 1 + the deepest one read; NULL on or behind a cycle.

    Only dependencies on cells in ``formulas`` count. Cells are settled bucket by bucket
    (``peel``); if that takes many rounds, chains of single dependencies are contracted by
    pointer doubling first. Takes the edges of ``formula_dependencies`` or ``formula_graph``; a
    block without formulas has level -1.
    """
    cells = materialize(formulas.select("cell").distinct())
    blocked = "step" in edges.columns
    step = F.col("step") if blocked else F.lit(1).cast("bigint")
    edges = edges.select("cell", F.col("depends_on").alias("up"), step.alias("d"))
    nodes = cells.withColumn("level", F.lit(0).cast("bigint"))
    if blocked:
        blocks = edges.filter(is_virtual(F.col("cell"))).select("cell").distinct()
        nodes = materialize(nodes.unionByName(blocks.withColumn("level", F.lit(-1).cast("bigint"))))
    inner = materialize(
        edges.join(nodes.select("cell"), "cell", "left_semi").join(nodes.select(F.col("cell").alias("up")), "up", "left_semi").groupBy("cell", "up").agg(F.max("d").alias("d"))
    )
    roots = materialize(nodes.join(inner.select("cell").distinct(), "cell", "left_anti").select("cell", "level"))
    found, all_ = settle_levels(inner, roots, _TURNS)
    known = roots.unionByName(found)
    if not all_:
        known = materialize(known)
        known = known.unionByName(_levels_by_chains(materialize(inner.join(known.select("cell"), "cell", "left_anti")), known))
    return cells.join(known, "cell", "left")


def _levels_by_chains(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, level) of what is not settled yet."""
    single, branching = _chains(edges)
    chains = _jump(single.select("cell", "up", F.col("d").alias("dist"), F.lit(False).alias("flag"))).select("cell", "up", "dist", F.col("moved").alias("looping"))
    heads = chains.select(F.col("cell").alias("up"), F.col("up").alias("_head"), "dist", "looping")
    # what loops is never settled: its readers wait for a node that nobody settles
    never = F.lit(VIRTUAL + "never")
    short = branching.join(heads, "up", "left").select(
        "cell", F.when(F.coalesce("looping", F.lit(False)), never).otherwise(F.coalesce("_head", "up")).alias("up"), (F.coalesce("dist", F.lit(0)) + F.col("d")).alias("d"),
    ).groupBy("cell", "up").agg(F.max("d").alias("d"))
    found = materialize(settle_levels(materialize(short), roots)[0])
    at_heads = roots.unionByName(found).select(F.col("cell").alias("up"), "level")
    by_chain = chains.filter(~F.col("looping")).join(at_heads, "up").select("cell", (F.col("level") + F.col("dist")).alias("level"))
    return found.unionByName(by_chain)


def circular_cells(edges: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formula cells on a cycle or reading one."""
    return recalc_levels(edges, formulas).filter(F.col("level").isNull()).select("cell")


def formula_audit(cells: DataFrame) -> DataFrame:
    """Per formula: functions called, volatile, uses PREDICT, calls an unknown function."""
    found = extract_formulas(cells)
    bare = F.regexp_replace("formula", r'"[^"]*"', '""')
    calls = F.array_distinct(F.regexp_extract_all(bare, F.lit(_CALL), F.lit(1)))
    known = F.array(*[F.lit(n) for n in SUPPORTED])
    out = found.withColumn("functions", F.array_sort(calls))
    return out.select(
        cell_key(F.col("sheet"), F.col("address")).alias("cell"), "formula", "functions",
        F.arrays_overlap("functions", F.array(*[F.lit(n) for n in VOLATILE])).alias("is_volatile"),
        F.array_contains("functions", "PREDICT").alias("uses_predict"),
        (F.size(F.array_except("functions", known)) > 0).alias("is_unsupported"),
    )


def volatile_refresh_set(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells to recompute by hand: volatile formulas and all that depend on them."""
    return affected_cells(edges, formula_audit(cells).filter("is_volatile").select("cell"))
