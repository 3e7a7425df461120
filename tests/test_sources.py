"""File sources on small folders."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from amperoute.operators.conform import MissingColumns
from amperoute.sources import areas, files, workbook


@pytest.fixture
def folder(tmp_path):
    for day in ("20250630", "20250707"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "T1.csv").write_text(f"name,speed\nu,{day}\nu,2\n")
    (tmp_path / "20250707" / "other.csv").write_text("name,speed\nu,9\n")
    (tmp_path / "20250801").mkdir()
    (tmp_path / "20250801" / "Summary Book.xlsx").write_bytes(b"x")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "T1.csv").write_text("a\n1\n")
    return tmp_path


def test_discovery(spark, folder):
    listed = files.list_files(spark, str(folder))
    kinds = {r.folder: (r.weekly, r.monthly) for r in files.dated_folders(listed, "Summary Book.xlsx").collect()}
    assert kinds == {"20250630": (True, False), "20250707": (True, False), "20250801": (False, True)}
    mine = sorted(r.path for r in files.entity_files(listed, ["T1", "T2"]).collect())
    assert mine == ["20250630/T1.csv", "20250707/T1.csv"]


def test_ledger_takes_changed_files_again(spark, folder):
    def listed():
        return files.list_files(spark, str(folder), pattern="*.csv", with_hash=True)

    ledger = files.record_ingested(spark.createDataFrame([], files.LEDGER), listed())
    ledger = spark.createDataFrame([tuple(r) for r in ledger.collect()], files.LEDGER)
    assert files.not_ingested(listed(), ledger).isEmpty()
    (folder / "20250630" / "T1.csv").write_text("name,speed\nu,changed\n")
    assert [r.path for r in files.not_ingested(listed(), ledger).collect()] == ["20250630/T1.csv"]
    assert files.record_ingested(ledger, listed()).count() == ledger.count()


def test_ledger_json(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"20250625/Book.xlsx": "aa", "20250630\\T1.csv": "bb"}, indent=2))
    got = {r.path: r.hash for r in files.read_ledger_json(spark, str(tmp_path / "log.json"), "/data/in").collect()}
    assert got == {"20250625/Book.xlsx": "aa", "20250630/T1.csv": "bb"}


def test_csv_scan_keeps_place_and_stem(spark, folder):
    rows = files.read_csv(spark, [str(folder / "20250630"), str(folder / "20250707" / "T1.csv")], root=str(folder)).collect()
    assert {(r.code, r.path) for r in rows} == {("T1", "20250630/T1.csv"), ("T1", "20250707/T1.csv")}
    first = sorted((r for r in rows if r.path.startswith("20250630")), key=lambda r: r.row_no)
    assert [r.speed for r in first] == ["20250630", "2"]


def test_csv_encoding_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n\nzażółć\n".encode())
    (tmp_path / "b.csv").write_bytes("n\ncafé – x\n".encode("cp1252"))
    got = {r.n for r in files.read_csv_any_encoding(spark, str(tmp_path)).collect()}
    assert got == {"zażółć", "café – x"}


def write_workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = (
        f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="AA3" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45292.5</v></c><c r="B4" s="2"><v>0.25</v></c><c r="AA4"><v>7.5</v></c></row>'
        '<row r="6"><c r="A6" t="b"><v>1</v></c><c r="B6" t="str"><v>text</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="T1" sheetId="1" r:id="rId1"/><sheet name="HELP" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/s1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Day</t></si><si><r><t>Idle </t></r><r><t>Time</t></r></si><si><t>Far</t></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="165" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/s1.xml", sheet)


def test_workbook(spark, tmp_path):
    write_workbook(tmp_path / "b.xlsx")
    rows = workbook.read_workbooks(spark, str(tmp_path), header_row=3)
    assert {r.sheet for r in workbook.without_instructions(rows, ["help"]).select("sheet").collect()} == {"T1"}
    table = workbook.as_columns(workbook.read_workbooks(spark, str(tmp_path), header_row=3, sheets=["T1"]))
    assert table.columns == ["path", "sheet", "row_no", "Day", "Far", "Idle Time"]
    got = [tuple(r)[1:] for r in table.orderBy("row_no").collect()]
    assert got == [("T1", 4, "2024-01-01 12:00:00", "7.5", "0.25"), ("T1", 6, "true", None, "text")]


def test_area_layer(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"EJAREA": "yes"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"EJAREA": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"EJAREA": "N"}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    layer = areas.read_flagged_layer(spark, str(path))
    assert [r.ejarea for r in layer.collect()] == [True, True, False, False]
    parts = areas.polygons(layer.where("ejarea")).select(F.size("polygons").alias("n")).collect()
    assert [r.n for r in parts] == [1, 2]
    feature = json.loads(areas.as_feature_collection(layer).first().feature)
    assert feature["properties"] == {"ejarea": True} and feature["geometry"]["coordinates"] == [ring]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"A": 1}, "geometry": None}]}))
    with pytest.raises(MissingColumns):
        areas.read_flagged_layer(spark, str(path))


def test_parsed_sheets_land_as_files_read_by_column(spark):
    from amperoute.plans import loads

    rows = spark.range(5).selectExpr("id as row_no", "string(null) as elevation")
    landed = loads._landed(rows)
    assert landed.inputFiles() and sorted(r.row_no for r in landed.collect()) == [0, 1, 2, 3, 4] and landed.dtypes == rows.dtypes
