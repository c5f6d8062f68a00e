"""Readers, writers, stores, exports and streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tablescope.operators import lineage as G
from tablescope.plans import workflows as W
from tablescope.plans.explore import Exploration
from tablescope.plans.roles import PrepSpec, Roles, normalize_roles, resolve_features, roles_for_source
from tablescope.sources import export as E
from tablescope.sources import store as S
from tablescope.sources import tables as T
from tablescope.sources import workbook as B
from tablescope.streaming.scoring import score_stream, write_scores

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_xlsx(path, sheets, strings):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml" Type="x"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">{"".join(cells)}</row>' for r, cells in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture()
def books(tmp_path):
    for k in (1, 2):
        write_xlsx(tmp_path / f"b{k}.xlsx", {
            "Sheet1": [
                ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="inlineStr"><is><t>total</t></is></c>'],
                [f'<c r="A2"><v>{k}</v></c>', '<c r="B2"><v>2.5</v></c>', f'<c r="C2"><f>A2+B2</f><v>{k + 2.5}</v></c>'],
                ['<c r="A3"><v>7</v></c>', '<c r="C3" t="b"><v>1</v></c>'],
            ],
            "Other": [['<c r="A1" t="s"><v>0</v></c>']],
        }, ["a", "b"])
    return tmp_path


def test_workbooks(spark, books):
    cells = B.scan_workbooks(spark, str(books / "*.xlsx"))
    assert cells.select("path").distinct().count() == 2
    path = cells.filter(F.col("path").endswith("b1.xlsx")).first()["path"]
    table = B.sheet_table(cells, path, "Sheet1").orderBy("_row_id")
    assert [tuple(r) for r in table.collect()] == [(1, "1", "2.5", "3.5"), (2, "7", None, "true")]
    found = G.extract_formulas(cells).filter(F.col("path") == path).collect()
    assert [(r.address, r.formula, r.value) for r in found] == [("C2", "=A2+B2", "3.5")]
    facts = {(r.path[-7:], r.sheet): (r.row_count, r.column_count, r.formula_count) for r in B.sheet_catalog(cells).collect()}
    assert facts[("b1.xlsx", "Sheet1")] == (3, 3, 1) and facts[("b2.xlsx", "Other")] == (1, 1, 0)
    edges = G.formula_dependencies(cells.filter(F.col("path") == path))
    assert {tuple(r) for r in edges.collect()} == {("Sheet1!C2", "Sheet1!A2"), ("Sheet1!C2", "Sheet1!B2")}


STYLES = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy/mm/dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts>' \
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'


def test_typed_sheets_and_catalog(spark, tmp_path):
    """Two sheets of one file and a second file: names, types, missing cells and first rows of each."""
    rows = [['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="D1" t="s"><v>0</v></c>', '<c r="E1"><v>2024</v></c>']]
    for i in range(2, 15):
        gap = "" if i == 3 else f'<c r="B{i}"><v>{i}.5</v></c>'
        rows.append([f'<c r="A{i}"><v>{i}</v></c>', gap, f'<c r="C{i}" s="{1 + i % 2}"><v>{46000 + i}.25</v></c>', f'<c r="D{i}" t="s"><v>{2 + i % 2}</v></c>', f'<c r="E{i}" s="3"><v>{i}</v></c>'])
    rows[4][4] = '<c r="E5" t="e"><v>#DIV/0!</v></c>'
    write_xlsx(tmp_path / "b.xlsx", {"Main": rows, "Empty": [], "Head": [['<c r="A1" t="s"><v>0</v></c>']]}, ["name", "x", "NA", "text"])
    with zipfile.ZipFile(tmp_path / "b.xlsx", "a") as z:
        z.writestr("xl/styles.xml", STYLES)
    write_xlsx(tmp_path / "c.xlsx", {"Main": [['<c r="A1" t="s"><v>0</v></c>'], ['<c r="A2" t="b"><v>1</v></c>'], ['<c r="A3" t="b"><v>0</v></c>']]}, ["flag"])
    cells = B.scan_workbooks(spark, str(tmp_path / "*.xlsx"))
    sheets = {(r.path[-6:], r.sheet): r for r in B.workbook_catalog(cells).collect()}
    assert set(sheets) == {("b.xlsx", "Main"), ("b.xlsx", "Head"), ("c.xlsx", "Main")}
    main = sheets["b.xlsx", "Main"]
    assert main.row_count == 13 and [tuple(c) for c in main.columns] == [
        ("name", "bigint", 0), ("x", "double", 1), ("column_3", "timestamp", 0), ("name.1", "string", 7), ("2024", "double", 1)]
    assert len(main.preview_rows) == 10 and main.preview_rows[1] == {"name": "3", "x": "", "column_3": "46003.25", "name.1": "text", "2024": "3"}
    head, flags = sheets["b.xlsx", "Head"], sheets["c.xlsx", "Main"]
    assert (head.row_count, [tuple(c) for c in head.columns], head.preview_rows) == (0, [("name", "double", 0)], [])
    assert [tuple(c) for c in flags.columns] == [("flag", "boolean", 0)] and flags.preview_rows[1] == {"flag": "false"}
    table = B.typed_sheet(cells, main.path, "Main")
    assert [t for _, t in table.dtypes] == ["bigint", "bigint", "double", "timestamp", "string", "double"]
    second = table.filter("_row_id = 2").first()
    assert (second["name"], second["x"], second["name.1"], second["2024"]) == (3, None, "text", 3.0)
    assert second["column_3"].isoformat() == "2025-12-12T06:00:00"
    assert B.typed_sheet(cells, main.path, "Empty").count() == 0
    fitted = W.fit_supervised(table.withColumnRenamed("2024", "y").fillna(0.0, ["y"]).drop("name.1", "column_3"), Roles(("name", "x"), "y"), PrepSpec(), "linear_regression", task="regression", order_by=["_row_id"])
    assert fitted.metrics.count() > 0  # numbers of a sheet are numeric features without further steps


def test_formula_store(spark, books):
    cells = B.scan_workbooks(spark, str(books / "b1.xlsx"))
    store = str(books / "formulas")
    assert S.load_formulas(spark, "w1", store).count() == 0
    assert S.load_formulas(spark, "w1", store, cells).count() == 1
    S.save_formulas(B.scan_workbooks(spark, str(books / "b2.xlsx")), "w2", store)
    S.save_formulas(cells, "w1", store)
    one = S.load_formulas(spark, "w1", store)
    assert one.first()["cached_value"] == "3.5" and S.load_formulas(spark, "w2", store).count() == 1
    assert "PartitionFilters: [isnotnull(workbook_id" in one._jdf.queryExecution().executedPlan().toString()


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d,e,f\n1,2.5,x,true,2026-01-05,NA\n2,NA,"y, z",false,2026-02-01,\n3,1e3,n/a,true,2026-03-01,\n')
    df = T.scan_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "timestamp", "f": "double"}
    assert [r.c for r in df.collect()] == ["x", "y, z", None]
    assert [r.b for r in df.collect()] == [2.5, None, 1000.0]
    given = T.scan_csv(spark, str(tmp_path / "t.csv"), "a int, b string, c string, d boolean, e date, f double")
    assert given.first()["e"].isoformat() == "2026-01-05"


def test_write_and_load_source(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    out = T.write_result(df, str(tmp_path / "r"))
    assert T.load_source(spark, out["parquet"], df.limit(0))[1] == "prepare_job"
    table, kind = T.load_source(spark, str(tmp_path / "none"), df)
    assert kind == "workbook" and table.count() == 1
    assert roles_for_source(["a"], Roles(("a", "x"), "gone")) == Roles(("a",), None)


def test_json_rows(spark):
    df = spark.createDataFrame([('{"f1": 1.0, "f2": "a"}',), ('{"f1": 2.0}',)], "body string")
    assert [tuple(r) for r in T.json_rows(df, "body", "f1 double, f2 string").collect()] == [(1.0, "a"), (2.0, None)]
    assert T.rows_to_df(spark, [{"f1": 1.0}, {"f1": 2.0}]).count() == 2


def test_runs_and_exploration(spark, tmp_path):
    runs = str(tmp_path / "runs")
    assert S.find_run(spark, runs, "x") is None
    S.log_run(spark, runs, "x", "prepare", "running", {"a": 1}, {})
    S.log_run(spark, runs, "x", "prepare", "completed", {"a": 1}, {"rows": 3}, "/tmp/r")
    assert S.find_run(spark, runs, "x")["status"] == "completed"
    t = spark.createDataFrame([("v", 1.0)], "name string, x double")
    ex = Exploration(t, {"target_kind": "classification"}, t, spark.createDataFrame([("usable_signal",)], "overall_verdict string"), Roles())
    S.save_exploration(ex, "w", "Sheet1", str(tmp_path / "ex"))
    S.save_exploration(ex, "w2", "Sheet1", str(tmp_path / "ex"))
    back = S.load_exploration(spark, "w", "Sheet1", str(tmp_path / "ex"))
    assert back["evaluation"]["overall_verdict"] == "usable_signal" and back["profile"] == [{"name": "v", "x": 1.0}]
    assert S.load_exploration(spark, "nope", "Sheet1", str(tmp_path / "ex")) is None


def test_export(spark, tmp_path):
    results = spark.createDataFrame([(1,)], "a long")
    metrics = spark.createDataFrame([("f1", 0.5)], "metric string, value double")
    matrix = spark.createDataFrame([("a", "b", 2)], "truth string, prediction string, n long")
    out = E.export_bundle(str(tmp_path / "e"), results, metrics, workbook_id="w", active_sheet="s", nested={"confusion_matrix": matrix})
    got = {r.key: r.value for r in spark.read.parquet(out["metrics"]).collect()}
    assert got["f1"] == "0.5" and json.loads(got["confusion_matrix"])[0]["n"] == 2
    assert [tuple(r) for r in spark.read.parquet(out["evaluation"]).collect()] == [("evaluation_not_available", "true")]
    assert spark.read.parquet(out["formulas"]).first()["workbook_id"] == "w"


def test_streaming_scores(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), "x" if i % 10 > 4 else "y") for i in range(60)], "id long, a double, y string")
    model = W.fit_supervised(df, Roles(("a",), "y", "id"), PrepSpec(), "logistic_regression", order_by=["id"]).model
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = write_scores(score_stream(model, stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 60 and out.filter("y = _predicted_class").count() > 50
    with pytest.raises(ValueError):
        score_stream(model, df)


def test_roles():
    cols = ["id", "a", "_x", "norm_a", "y", "u", "t"]
    assert resolve_features(cols, Roles(("a", "y", "zz"), "y", "id")) == ["a"]
    assert resolve_features(cols, Roles((), "y", "id", user="u", timestamp="t")) == ["a"]
    got = normalize_roles(cols, Roles(("a", "u"), "nope", "id", ("u", "zz")))
    assert got.label is None and got.features == ("a",) and got.exclude == ("id", "u")
    with pytest.raises(ValueError):
        PrepSpec(normalization="weird")
