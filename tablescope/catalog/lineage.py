"""Formula lineage over cell tables derived from orders: one sheet per ten orders."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.operators import lineage as G
from tablescope.operators.ordering import number_within

C, L = F.col, F.lit


def cells(s, d):
    """Values in A, formulas in B to H: doubling, running total, ranges, cross-sheet, cycles, volatile, unknown."""
    k = C("o_orderkey")
    base = read(s, d, "orders").select(
        F.floor(k / 10).cast("bigint").alias("n"), (k % 10 + 1).alias("r"), C("o_totalprice").cast("string").alias("price"), C("o_orderstatus").alias("status")
    ).withColumn("sheet", F.concat(L("S"), C("n").cast("string")))
    r, up = C("r").cast("string"), (C("r") - 1).cast("string")
    first = C("r") == 1
    loops = first & (C("n") % 7 == 0)

    def cell(col, formula, value=None, when=None):
        null = L(None).cast("string")
        made = F.struct(
            F.concat(L(col), r).alias("address"), (null if formula is None else formula).alias("formula"), (null if value is None else value).alias("value")
        )
        return made if when is None else F.when(when, made)

    made = F.array(
        cell("A", None, C("price")),
        cell("B", F.concat(L("=A"), r, L("*2+$A"), r)),
        cell("C", F.when(first, L("=B1")).otherwise(F.concat(L("=B"), r, L("+C"), up))),
        cell("D", L("=SUM(A1:B10)"), when=first),
        cell("E", F.concat(L("='S0'!A1+S"), (C("n") - 1).cast("string"), L("!D1")), when=first & (C("n") > 0)),
        cell("F", L("=G1"), when=loops),
        cell("G", L("=IF(A1,F1,0)"), when=loops),
        cell("H", L("=F1+1"), when=loops),
        cell("I", F.when(C("n") % 3 == 0, L("=TODAY()+A1")).when(C("n") % 3 == 1, L("=FOO(A1,\"BAR(1)\")")).otherwise(L("=PREDICT(A1,B1)+RANDBETWEEN(1,3)")), when=first),
        cell("J", L("=Missing!A1+ZZ1"), when=first),
        cell("K", None, L("=LEFT(A1,2)"), when=first),
    )
    return base.select("sheet", "n", "r", "status", F.explode(F.array_compact(made)).alias("c")).select("sheet", "n", "r", "status", "c.*")


_CELLS = """
    o AS (SELECT o_orderkey // 10 AS n, o_orderkey % 10 + 1 AS r, CAST(o_totalprice AS VARCHAR) AS price, o_orderstatus AS status FROM orders),
    cells AS (
        SELECT 'S' || n AS sheet, n, r, status, 'A' || r AS address, NULL AS formula FROM o
        UNION ALL SELECT 'S' || n, n, r, status, 'B' || r, '=A' || r || '*2+$A' || r FROM o
        UNION ALL SELECT 'S' || n, n, r, status, 'C' || r, CASE WHEN r = 1 THEN '=B1' ELSE '=B' || r || '+C' || (r - 1) END FROM o
        UNION ALL SELECT 'S' || n, n, r, status, 'D1', '=SUM(A1:B10)' FROM o WHERE r = 1
        UNION ALL SELECT 'S' || n, n, r, status, 'E1', '=''S0''!A1+S' || (n - 1) || '!D1' FROM o WHERE r = 1 AND n > 0
        UNION ALL SELECT 'S' || n, n, r, status, 'F1', '=G1' FROM o WHERE r = 1 AND n % 7 = 0
        UNION ALL SELECT 'S' || n, n, r, status, 'G1', '=IF(A1,F1,0)' FROM o WHERE r = 1 AND n % 7 = 0
        UNION ALL SELECT 'S' || n, n, r, status, 'H1', '=F1+1' FROM o WHERE r = 1 AND n % 7 = 0
        UNION ALL SELECT 'S' || n, n, r, status, 'I1', CASE n % 3 WHEN 0 THEN '=TODAY()+A1' WHEN 1 THEN '=FOO(A1,"BAR(1)")' ELSE '=PREDICT(A1,B1)+RANDBETWEEN(1,3)' END FROM o WHERE r = 1
        UNION ALL SELECT 'S' || n, n, r, status, 'J1', '=Missing!A1+ZZ1' FROM o WHERE r = 1
        UNION ALL SELECT 'S' || n, n, r, status, 'K1', NULL FROM o WHERE r = 1
    )"""
# Edges written out from the generator, independent of any reference pattern.
_EDGES = f"""{_CELLS},
    edges AS (
        SELECT DISTINCT sheet || '!' || address AS cell, 'S' || dn || '!' || dep AS depends_on FROM (
            SELECT sheet, address, n AS dn, 'A' || r AS dep FROM cells WHERE address[1] = 'B'
            UNION ALL SELECT sheet, address, n, 'B' || r FROM cells WHERE address[1] = 'C'
            UNION ALL SELECT sheet, address, n, 'C' || (r - 1) FROM cells WHERE address[1] = 'C' AND r > 1
            UNION ALL SELECT sheet, address, n, x || i FROM cells, (VALUES ('A'), ('B')) t(x), range(1, 11) g(i) WHERE address = 'D1'
            UNION ALL SELECT sheet, address, 0, 'A1' FROM cells WHERE address = 'E1'
            UNION ALL SELECT sheet, address, n - 1, 'D1' FROM cells WHERE address = 'E1'
            UNION ALL SELECT sheet, address, n, 'G1' FROM cells WHERE address = 'F1'
            UNION ALL SELECT sheet, address, n, 'A1' FROM cells WHERE address = 'G1'
            UNION ALL SELECT sheet, address, n, 'F1' FROM cells WHERE address IN ('G1', 'H1')
            UNION ALL SELECT sheet, address, n, 'A1' FROM cells WHERE address = 'I1'
            UNION ALL SELECT sheet, address, n, 'B1' FROM cells WHERE address = 'I1' AND n % 3 = 2
            UNION ALL SELECT sheet, address, n, 'BAR1' FROM cells WHERE false
        )
    )"""
_FORMULAS = "formulas AS (SELECT sheet || '!' || address AS cell FROM cells WHERE formula IS NOT NULL)"


def _edges(s, d):
    return G.formula_dependencies(cells(s, d))


def _formula_cells(s, d):
    return cells(s, d).filter(C("formula").isNotNull()).select(G.cell_key(C("sheet"), C("address")).alias("cell"))


def _changed(s, d):
    """Prices of some orders changed."""
    return cells(s, d).filter(C("address").startswith("A") & (C("status") == "F") & (C("n") % 5 == 1)).select(
        G.cell_key(C("sheet"), C("address")).alias("cell")
    )


_CHANGED = "changed AS (SELECT sheet || '!' || address AS cell FROM cells WHERE address[1] = 'A' AND status = 'F' AND n % 5 = 1)"


def _closure(start):
    return f"""WITH RECURSIVE {_EDGES}, {start}, hit AS (SELECT cell FROM changed UNION SELECT e.cell FROM edges e JOIN hit h ON e.depends_on = h.cell) SELECT cell FROM hit"""


def _levels_sql(select):
    """Longest path by union of (cell, length); cycles and what they feed have no level."""
    return f"""
        WITH RECURSIVE {_EDGES}, {_FORMULAS},
        inner_edges AS (SELECT * FROM edges WHERE cell IN (FROM formulas) AND depends_on IN (FROM formulas)),
        loops AS (SELECT sheet || '!' || address AS cell FROM cells WHERE address IN ('F1', 'G1', 'H1')),
        bad AS (SELECT cell FROM loops UNION SELECT e.cell FROM inner_edges e JOIN bad b ON e.depends_on = b.cell),
        steps AS (SELECT cell, 0::BIGINT AS level FROM formulas WHERE cell NOT IN (SELECT cell FROM inner_edges)
                  UNION SELECT e.cell, p.level + 1 FROM inner_edges e JOIN steps p ON e.depends_on = p.cell WHERE e.cell NOT IN (FROM bad)),
        levels AS (SELECT f.cell, CASE WHEN f.cell NOT IN (FROM bad) THEN max(level) END AS level FROM formulas f LEFT JOIN steps s ON s.cell = f.cell GROUP BY f.cell)
        {select}"""


def _deep_cells(s, d):
    """A sheet per thousand orders; P reads P and Q of the row above, Q reads P: two levels a row. S sums whole columns."""
    k = C("o_orderkey")
    base = read(s, d, "orders").select(F.concat(L("S"), F.floor(k / 1000).cast("string")).alias("sheet"), (k % 1000 + 1).alias("r"), C("o_totalprice").cast("string").alias("price"))
    r, up, first = C("r").cast("string"), (C("r") - 1).cast("string"), C("r") == 1
    null = L(None).cast("string")

    def cell(col, formula, value=null):
        return F.struct(F.concat(L(col), r).alias("address"), formula.alias("formula"), value.alias("value"))

    made = F.array(
        cell("A", null, C("price")),
        cell("P", F.when(first, L("=A1")).otherwise(F.concat(L("=A"), r, L("+P"), up, L("+Q"), up))),
        cell("Q", F.when(first, L("=P1")).otherwise(F.concat(L("=P"), r, L("*Q"), up))),
        F.when(first, cell("S", L("=SUM(A1:Q1048576)"))), F.when(first, cell("T", L("=SUM(P1:P1000)/S1"))),
    )
    return base.select("sheet", "r", F.explode(F.array_compact(made)).alias("c")).select("sheet", "r", "c.*")


def _deep_levels(s, d):
    cells = _deep_cells(s, d)
    formulas = cells.filter(C("formula").isNotNull()).select(G.cell_key(C("sheet"), C("address")).alias("cell"))
    return G.recalc_levels(G.formula_graph(cells), formulas)


# Rows of a sheet have no gaps, so the level of a row follows from its number.
_DEEP_SQL = """
    WITH o AS (SELECT 'S' || o_orderkey // 1000 AS sheet, o_orderkey % 1000 + 1 AS r FROM orders), n AS (SELECT sheet, max(r) AS n FROM o GROUP BY 1)
    SELECT sheet || '!P' || r AS cell, 2 * (r - 1) AS level FROM o UNION ALL SELECT sheet || '!Q' || r, 2 * r - 1 FROM o
    UNION ALL SELECT sheet || '!S1', 2 * n FROM n UNION ALL SELECT sheet || '!T1', 2 * n + 1 FROM n"""


def _range_affected(s, d):
    cells = _deep_cells(s, d)
    changed = cells.filter(C("address").startswith("A") & (C("r") == 990)).select(G.cell_key(C("sheet"), C("address")).alias("cell"))
    return G.affected_cells(G.formula_graph(cells), changed)


_RANGE_AFFECTED_SQL = """
    WITH o AS (SELECT 'S' || o_orderkey // 1000 AS sheet, o_orderkey % 1000 + 1 AS r FROM orders), c AS (SELECT sheet FROM o WHERE r = 990)
    SELECT sheet || '!A990' AS cell FROM c UNION ALL SELECT sheet || '!' || x || '1' FROM c, (VALUES ('S'), ('T')) t(x)
    UNION ALL SELECT o.sheet || '!' || x || r FROM o, (VALUES ('P'), ('Q')) t(x) WHERE r >= 990 AND o.sheet IN (FROM c)"""


def _audit(s, d):
    out = G.formula_audit(cells(s, d))
    return out.withColumn("functions", F.array_join("functions", ","))


_AUDIT_SQL = f"""
    WITH {_CELLS}, f AS (SELECT sheet || '!' || address AS cell, address, n, coalesce(formula, '=LEFT(A1,2)') AS formula FROM cells WHERE formula IS NOT NULL OR address = 'K1')
    SELECT cell, formula, CASE WHEN address = 'D1' THEN 'SUM' WHEN address = 'G1' THEN 'IF' WHEN address = 'K1' THEN 'LEFT'
           WHEN address = 'I1' THEN CASE n % 3 WHEN 0 THEN 'TODAY' WHEN 1 THEN 'FOO' ELSE 'PREDICT,RANDBETWEEN' END ELSE '' END AS functions,
           address = 'I1' AND n % 3 <> 1 AS is_volatile, address = 'I1' AND n % 3 = 2 AS uses_predict, address = 'I1' AND n % 3 = 1 AS is_unsupported FROM f"""


def _extract(s, d):
    return G.extract_formulas(cells(s, d)).select("sheet", "address", "formula")


def _sheet_catalog(s, d):
    from tablescope.sources.workbook import sheet_catalog

    r, c = G.parse_address(C("address"))
    placed = cells(s, d).select(L("book").alias("path"), "sheet", r.alias("row"), c.alias("col"), "value", "formula")
    return sheet_catalog(placed).drop("path")


_CATALOG_SQL = f"""WITH {_CELLS}, x AS (SELECT sheet, n, r, address, CASE WHEN address[1] = 'A' THEN 'v' WHEN address = 'K1' THEN 'v' END AS value, formula FROM cells)
    SELECT sheet, max(r)::BIGINT AS row_count, 11::BIGINT AS column_count, count(value) AS value_count, count(formula) AS formula_count FROM x GROUP BY 1"""

def _sheets(s, d):
    """Cell table of one sheet per order priority, with typed, mixed, sparse, unnamed and repeated columns."""
    orders = number_within(read(s, d, "orders"), "o_orderpriority", ["o_orderkey"], "row")
    k = C("o_orderkey")
    day = F.date_diff(C("o_orderdate").cast("date"), L("1899-12-30").cast("date")).cast("string")
    filled = [
        ("n", k.cast("string")), ("n", F.when(k % 5 != 0, C("o_custkey").cast("string"))), ("n", C("o_totalprice").cast("string")),
        ("s", F.when(k % 3 == 0, L("NA")).otherwise(C("o_orderstatus"))), ("b", F.when(k % 2 == 0, L("true")).otherwise(L("false"))), ("d", day),
        (None, C("o_orderstatus")), ("e", L("#DIV/0!")), ("n", k.cast("string")),
    ]

    def cell(row, col, kind, value):
        return F.struct(row.cast("int").alias("row"), L(col).alias("col"), value.alias("value"), kind.alias("kind"))

    mixed = F.when(k % 4 == 0, L("s")).otherwise(L("n"))  # text among numbers
    body = F.array(*[cell(C("row"), i, mixed if kind is None else L(kind), v if kind is not None else F.when(k % 4 == 0, C("o_orderstatus")).otherwise(k.cast("string"))) for i, (kind, v) in enumerate(filled)])
    head = F.array(*[cell(L(0), i, L("s"), L(n)) for i, n in enumerate(_HEADER) if n])
    rows = orders.select(C("o_orderpriority").alias("sheet"), F.explode(body).alias("c"))
    heads = orders.select(C("o_orderpriority").alias("sheet")).distinct().select("sheet", F.explode(head).alias("c"))
    both = rows.unionByName(heads).select(L("book").alias("path"), "sheet", "c.*").filter(C("value").isNotNull())
    return both.withColumns({"address": G.to_address(C("row"), C("col")), "formula": L(None).cast("string")})


_HEADER = ["key", "cust", "price", "status", "even", "day", "mixed", None, "key"]
_SHEET_NAMES = ["key", "cust", "price", "status", "even", "day", "mixed", "column_8", "key.1"]
_SHEET_TYPES = "CASE {c} WHEN 0 THEN 'bigint' WHEN 1 THEN CASE WHEN gaps > 0 THEN 'double' ELSE 'bigint' END WHEN 2 THEN 'double' WHEN 4 THEN 'boolean' WHEN 5 THEN 'timestamp' WHEN 7 THEN 'double' WHEN 8 THEN 'bigint' ELSE 'string' END"
_SHEET_COLUMNS_SQL = " UNION ALL ".join(f"""
    SELECT sheet, {i} AS col, '{n}' AS name, {_SHEET_TYPES.format(c=i)} AS inferred_type,
           {'gaps' if i == 1 else 'na' if i == 3 else 'n' if i == 7 else '0'}::BIGINT AS missing_count, n AS row_count
    FROM (SELECT o_orderpriority AS sheet, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS gaps, count(*) FILTER (o_orderkey % 3 = 0) AS na FROM orders GROUP BY 1)"""
    for i, n in enumerate(_SHEET_NAMES))


def _sheet_columns(s, d):
    from tablescope.sources.workbook import sheet_columns

    return sheet_columns(_sheets(s, d)).drop("path")


def _sheet_previews(s, d):
    from tablescope.sources.workbook import workbook_catalog

    rows = workbook_catalog(_sheets(s, d)).select("sheet", "row_count", F.size("columns").alias("n_columns"), F.posexplode("preview_rows").alias("place", "r"))
    return rows.select("sheet", "row_count", "n_columns", "place", *[F.element_at("r", n).alias(n.replace(".", "_")) for n in _SHEET_NAMES if n != "price"])


_SHEET_PREVIEW_SQL = """
    SELECT o_orderpriority AS sheet, n AS row_count, 9 AS n_columns, (r - 1)::INT AS place, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR ELSE '' END AS cust,
           CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even,
           date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR AS day, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE o_orderkey::VARCHAR END AS mixed,
           '' AS column_8, o_orderkey::VARCHAR AS key_1
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= 10"""


def _typed_sheet(s, d):
    from tablescope.sources.workbook import typed_sheet

    table = typed_sheet(_sheets(s, d), "book", "2-HIGH")
    return table.select(
        "_row_id", (C("key") + 1).alias("key"), (C("cust") / 2).alias("half"), "price", "status", (~C("even")).alias("odd"), F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"), "mixed", "column_8",
        (C("`key.1`") * 2).alias("twice"))


_TYPED_SHEET_SQL = """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_id, o_orderkey + 1 AS key, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey / 2.0::DOUBLE END AS half, o_totalprice AS price,
           CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, o_orderkey % 2 <> 0 AS odd, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS day,
           CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE o_orderkey::VARCHAR END AS mixed, NULL::DOUBLE AS column_8, o_orderkey * 2 AS twice FROM orders WHERE o_orderpriority = '2-HIGH'"""

QUERIES = {
    "sheet_columns": (_sheet_columns, _SHEET_COLUMNS_SQL),
    "sheet_preview": (_sheet_previews, _SHEET_PREVIEW_SQL),
    "typed_sheet": (_typed_sheet, _TYPED_SHEET_SQL),
    "formula_cells": (_extract, f"WITH {_CELLS} SELECT sheet, address, coalesce(formula, '=LEFT(A1,2)') AS formula FROM cells WHERE formula IS NOT NULL OR address = 'K1'"),
    "sheet_catalog": (_sheet_catalog, _CATALOG_SQL),
    "formula_deps": (_edges, f"WITH {_EDGES} SELECT * FROM edges"),
    "affected_cells": (lambda s, d: G.affected_cells(_edges(s, d), _changed(s, d)), _closure(_CHANGED)),
    "recalc_levels": (lambda s, d: G.recalc_levels(_edges(s, d), _formula_cells(s, d)), _levels_sql("SELECT * FROM levels")),
    "recalc_levels_deep": (_deep_levels, _DEEP_SQL),
    "range_affected_cells": (_range_affected, _RANGE_AFFECTED_SQL),
    "formula_graph_levels": (
        lambda s, d: G.recalc_levels(G.formula_graph(cells(s, d)), _formula_cells(s, d)), _levels_sql("SELECT * FROM levels")
    ),
    "dependencies_of": (
        lambda s, d: G.dependencies_of(_edges(s, d), _formula_cells(s, d).filter(C("cell").endswith("!D1") | C("cell").endswith("!E1"))),
        f"WITH {_EDGES} SELECT * FROM edges WHERE cell LIKE '%!D1' OR cell LIKE '%!E1'",
    ),
    "circular_cells": (lambda s, d: G.circular_cells(_edges(s, d), _formula_cells(s, d)), _levels_sql("SELECT cell FROM levels WHERE level IS NULL")),
    "formula_audit": (_audit, _AUDIT_SQL),
    "volatile_refresh_set": (
        lambda s, d: G.volatile_refresh_set(cells(s, d), _edges(s, d)),
        _closure("changed AS (SELECT sheet || '!' || address AS cell FROM cells WHERE address = 'I1' AND n % 3 <> 1)"),
    ),
    "dependents_of": (
        lambda s, d: G.dependents_of(_edges(s, d), _changed(s, d)),
        f"WITH {_EDGES}, {_CHANGED} SELECT * FROM edges WHERE depends_on IN (FROM changed)",
    ),
    "replace_dependencies": (
        lambda s, d: G.replace_dependencies(
            _edges(s, d), _formula_cells(s, d).filter(C("cell").endswith("!D1")).select("cell", F.replace("cell", L("!D1"), L("!A1")).alias("depends_on")),
            _formula_cells(s, d).filter(C("cell").endswith("!D1") | C("cell").endswith("!E1")),
        ),
        f"WITH {_EDGES} SELECT * FROM edges WHERE cell NOT LIKE '%!D1' AND cell NOT LIKE '%!E1' UNION ALL SELECT sheet || '!D1', sheet || '!A1' FROM cells WHERE address = 'D1'",
    ),
}
