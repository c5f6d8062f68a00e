"""Workbooks as cell tables: one task per file, XML read with the standard library."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions.dates import EPOCH
from tablescope.sources.tables import MISSING_TEXTS

CELL_SCHEMA = "path string, sheet string, row int, col int, address string, value string, formula string, kind string"

# XML namespaces of the spreadsheet format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Built-in number formats that show a date or a time.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))

_BATCH = 50_000
PREVIEW_ROWS = 10
TASK_CELLS = 500_000

# What a column's values may be; the kinds of all its values are or-ed together.
_WHOLE, _FRACTION, _LOGIC, _DATE, _TEXT = 1, 2, 4, 8, 16


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in links}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    out = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        part = target[sheet.get(f"{_REL}id")].lstrip("/")
        out.append((sheet.get("name"), part if part.startswith("xl/") else f"xl/{part}"))
    return out


def _date_styles(book: zipfile.ZipFile) -> frozenset[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return frozenset()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")

    def dated(number: int) -> bool:
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|General', "", custom.get(number, ""))
        return bool(re.search("[dmyhs]", bare, re.IGNORECASE)) if number in custom else number in _DATE_FORMATS

    return frozenset(i for i, x in enumerate(styles if styles is not None else ()) if dated(int(x.get("numFmtId") or 0)))


def _position(address: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)([0-9]+)$", address).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _sheet_cells(path: str, name: str, xml: io.IOBase, strings: list[str], dates: frozenset[int]) -> Iterator[tuple]:
    """Cells of one sheet, streamed; finished rows are freed. A number shown as a date has kind ``d``."""
    for _, node in ElementTree.iterparse(xml):
        if node.tag != f"{_MAIN}row":
            continue
        for cell in node.iter(f"{_MAIN}c"):
            kind, raw, formula = cell.get("t", "n"), cell.findtext(f"{_MAIN}v"), cell.findtext(f"{_MAIN}f")
            if kind == "s" and raw is not None:
                raw = strings[int(raw)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif kind == "b" and raw is not None:
                raw = "true" if raw == "1" else "false"
            elif kind == "n" and raw is not None and int(cell.get("s") or 0) in dates:
                kind = "d"
            if raw is None and formula is None:
                continue
            row, col = _position(cell.get("r"))
            yield path, name, row, col, cell.get("r"), raw, formula, kind
        node.clear()


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                strings, dates = _shared_strings(book), _date_styles(book)
                for name, part in _sheets(book):
                    rows: list[tuple] = []
                    with book.open(part) as xml:
                        for cell in _sheet_cells(path, name, xml, strings, dates):
                            rows.append(cell)
                            if len(rows) >= _BATCH:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)


def scan_workbooks(spark: SparkSession, glob: str) -> DataFrame:
    """All cells of all sheets of the ``.xlsx`` files matching ``glob``; row and col from 0."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(_read_files, CELL_SCHEMA)


def sheet_table(cells: DataFrame, path: str, sheet: str) -> DataFrame:
    """One sheet as a table: the first row names the columns, the others become rows.

    Values are text; ``_row_id`` counts the data rows from 1. Only the header is fetched.
    """
    own = cells.filter((F.col("path") == path) & (F.col("sheet") == sheet))
    header = own.filter("row = 0").select("col", "value").orderBy("col").collect()
    names = {r["col"]: (r["value"] or f"column_{r['col'] + 1}") for r in header}
    picks = [F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in names.items()]
    return own.filter("row > 0").groupBy(F.col("row").cast("bigint").alias("_row_id")).agg(*picks)


def _known(value: Column, kind: Column) -> Column:
    """The value, NULL where it reads as missing: error cells and texts such as "NA"."""
    text = kind.isin("s", "str", "inlineStr")
    return F.when((kind != "e") & ~(text & value.isin(*MISSING_TEXTS)), value)


def _kind_bit(value: Column, kind: Column) -> Column:
    """Which of the five kinds a known value is; other kinds of cells count as text."""
    number = value.try_cast("double")
    whole = (F.floor(number) == number) & (F.abs(number) < 2.0**53)
    return (
        F.when(value.isNull(), 0).when(kind == "b", _LOGIC).when((kind == "d") & number.isNotNull(), _DATE)
        .when((kind == "n") & number.isNotNull(), F.when(whole, _WHOLE).otherwise(_FRACTION)).otherwise(_TEXT)
    )


def sheet_columns(cells: DataFrame) -> DataFrame:
    """path, sheet, col, name, inferred_type, missing_count, row_count of every column of every sheet.

    One aggregation over the cell table for all sheets at once: the kinds of a column's values
    are or-ed, and the union decides: whole numbers, numbers, logicals or dates if there is
    nothing else, text otherwise. Whole numbers with gaps are doubles, a column without values
    too. The first row gives the names: ``column_N`` where it is empty, a repeated name gets
    ``.1``, ``.2`` and so on. Columns without any cell up to the sheet's last are listed too.
    """
    value = _known(F.col("value"), F.col("kind"))
    data = F.col("row") > 0
    # the header is a key first: states of fixed width are hashed, a text among them would sort all cells
    # (and so would max(header), where Spark finds the first grouping redundant)
    by_header = cells.groupBy("path", "sheet", "col", F.when(~data, F.col("value")).alias("header")).agg(
        F.max("row").alias("last"), F.count(F.when(data, value)).alias("filled"),
        F.bit_or(F.when(data, _kind_bit(value, F.col("kind"))).otherwise(0)).alias("kinds"),
    )
    folded = by_header.groupBy("path", "sheet", "col").agg(
        F.max("last").alias("last"), F.sum("filled").alias("filled"), F.bit_or("kinds").alias("kinds"), F.array_max(F.collect_list("header")).alias("header"))
    sheets = folded.groupBy("path", "sheet").agg(F.max("last").cast("bigint").alias("row_count"), F.max("col").alias("width"))
    slots = sheets.select("path", "sheet", "row_count", F.explode(F.sequence(F.lit(0), "width")).alias("col"))
    placed = slots.join(folded.drop("last"), ["path", "sheet", "col"], "left")
    plain = F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("column_"), (F.col("col") + 1).cast("string")))
    again = F.row_number().over(W.partitionBy("path", "sheet", "plain").orderBy("col")) - 1  # a sheet's width at most
    missing = F.col("row_count") - F.coalesce("filled", F.lit(0))
    kinds = F.coalesce("kinds", F.lit(0))
    inferred = (
        F.when((kinds == 0) | (kinds == _FRACTION) | (kinds == _WHOLE + _FRACTION), "double").when(kinds == _WHOLE, F.when(missing > 0, "double").otherwise("bigint"))
        .when(kinds == _LOGIC, "boolean").when(kinds == _DATE, "timestamp").otherwise("string")
    )
    return placed.withColumn("plain", plain).select(
        "path", "sheet", "col", F.when(again > 0, F.concat("plain", F.lit("."), again.cast("string"))).otherwise(F.col("plain")).alias("name"),
        inferred.alias("inferred_type"), missing.alias("missing_count"), "row_count")


def _typed(value: Column, kind: str) -> Column:
    if kind == "timestamp":
        seconds = F.round(value.try_cast("double") * 86_400).cast("bigint")
        day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(seconds / 86_400).cast("int"))
        return day.cast("timestamp") + F.make_dt_interval(secs=F.pmod(seconds, F.lit(86_400)).cast("decimal(18,6)"))
    return value.try_cast(kind)


def typed_sheet(cells: DataFrame, path: str, sheet: str) -> DataFrame:
    """One sheet as a table with the names and types of ``sheet_columns``; ``_row_id`` counts data rows from 1.

    Numbers, logicals and dates arrive as such, missing texts as NULL. Only the sheet's column
    list, no value, is fetched. Rows without any cell are left out of the table, though they
    count as missing in the catalog.
    """
    own = cells.filter((F.col("path") == path) & (F.col("sheet") == sheet))
    columns = sheet_columns(own).orderBy("col").collect()
    value = _known(F.col("value"), F.col("kind"))
    picks = [F.max(F.when(F.col("col") == c["col"], value)).alias(f"_{c['col']}") for c in columns]
    if not picks:
        return own.select(F.col("row").cast("bigint").alias("_row_id"))
    # rows are dealt before they are put together, to tasks of a bounded number of cells
    count = columns[0]["row_count"] + sum(c["row_count"] - c["missing_count"] for c in columns)
    numbered = own.filter("row > 0").withColumn("_row_id", F.col("row").cast("bigint"))
    rows = numbered.repartition(max(1, math.ceil(count / TASK_CELLS)), "_row_id").groupBy("_row_id").agg(*picks)
    return rows.select("_row_id", *[_typed(F.col(f"_{c['col']}"), c["inferred_type"]).alias(c["name"]) for c in columns])


def sheet_preview(cells: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """path, sheet, preview_rows: the first rows of every sheet as maps of column name to text, "" where missing."""
    columns = sheet_columns(cells).select("path", "sheet", "col", "name", "row_count")
    head = cells.filter(F.col("row").between(1, rows)).select("path", "sheet", "col", "row", _known(F.col("value"), F.col("kind")).alias("v"))
    slots = columns.withColumn("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(rows), F.col("row_count")).cast("int")))).filter("row_count > 0")
    filled = slots.join(head, ["path", "sheet", "col", "row"], "left")
    by_row = filled.groupBy("path", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "name", F.coalesce("v", F.lit("")).alias("v")))).alias("r"))
    as_map = F.map_from_arrays(F.col("r.name"), F.col("r.v"))
    shown = by_row.groupBy("path", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", F.to_json(as_map).alias("m")))).alias("p"))
    return shown.select("path", "sheet", F.transform("p", lambda x: F.from_json(x["m"], "map<string,string>")).alias("preview_rows"))


def sheet_catalog(cells: DataFrame) -> DataFrame:
    """Per sheet: extent and number of filled and formula cells."""
    return cells.groupBy("path", "sheet").agg(
        (F.max("row") + 1).cast("bigint").alias("row_count"), (F.max("col") + 1).cast("bigint").alias("column_count"),
        F.count("value").alias("value_count"), F.count("formula").alias("formula_count"),
    )


def workbook_catalog(cells: DataFrame) -> DataFrame:
    """Per sheet: path, sheet, row_count (data rows), columns (name, inferred_type, missing_count) and preview_rows."""
    entry = F.struct("col", "name", "inferred_type", "missing_count")
    listed = sheet_columns(cells).groupBy("path", "sheet").agg(F.max("row_count").alias("row_count"), F.sort_array(F.collect_list(entry)).alias("c"))
    columns = F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["inferred_type"].alias("inferred_type"), x["missing_count"].alias("missing_count")))
    preview = F.coalesce("preview_rows", F.array().cast("array<map<string,string>>"))
    return listed.join(sheet_preview(cells), ["path", "sheet"], "left").select("path", "sheet", "row_count", columns.alias("columns"), preview.alias("preview_rows"))
