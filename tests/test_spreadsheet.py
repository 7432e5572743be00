import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pathloom.sources import spreadsheet

ROWS = [
    (1, "Zebras", 0, ["name", "note"], None), (1, "Zebras", 1, ["a <b> & \"c\"", None], None), (1, "Zebras", 3, [" spaced ", "line\nbreak\x01"], None),
    (0, "A sheet with a name of more than thirty-one letters", 0, ["id", "title", "id"], None), (0, "A sheet with a name of more than thirty-one letters", 1, ["7", "é€ ok", "8"], ["https://a.example/?x=1&y=\"2\"", None, None]),
    (2, "Empty", 0, [], None),
]


def rows_of(spark):
    return spark.createDataFrame(ROWS, "place int, sheet string, row_ix int, values array<string>, links array<string>").repartition(3)


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    spreadsheet.write_workbook(rows_of(spark), path)
    got = {(r["sheet"], r["row_ix"], r["col_ix"]): r["value"] for r in spreadsheet.read_cells(spark, path).collect()}
    want = {(s[:31], r, c): v.replace("\x01", "") for _, s, r, values, _ in ROWS for c, v in enumerate(values) if v is not None}
    assert got == want
    assert [n for n, _ in spreadsheet.sheet_parts(path)] == ["A sheet with a name of more tha", "Zebras", "Empty"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
        assert '<autoFilter ref="A1:B4"/>' in sheet and 'r="A1" s="1"' in sheet and 'width="10"' in sheet
        assert "HYPERLINK" in z.read("xl/worksheets/sheet1.xml").decode()
    assert os.listdir(tmp_path) == ["book.xlsx"]


def test_sheet_as_table(spark, tmp_path):
    path = f"file://{tmp_path}/book.xlsx"
    spreadsheet.write_workbook(rows_of(spark), path)
    found = spreadsheet.read_sheet(spark, path, "Zebras", {"note": "remark", "name": "who"})
    assert [tuple(r) for r in found.orderBy("row_ix").collect()] == [(1, None, 'a <b> & "c"'), (3, "line\nbreak", " spaced ")]
    assert spreadsheet.read_sheet(spark, path, "Zebras", skip=1).columns == ["row_ix", 'a <b> & "c"']
    with pytest.raises(Exception, match="no sheet"):
        spreadsheet.read_sheet(spark, path, "Lions").collect()
    with pytest.raises(Exception, match="there already"):
        spreadsheet.write_workbook(rows_of(spark), path, overwrite=False)
    with pytest.raises(Exception, match="mounted"):
        spreadsheet.read_cells(spark, "s3://bucket/book.xlsx").collect()


def test_failed_write_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    spreadsheet.write_workbook(rows_of(spark), path)
    before = open(path, "rb").read()
    bad = rows_of(spark).withColumn("row_ix", F.when(F.col("sheet") == "Zebras", F.lit(spreadsheet.MOST_ROWS)).otherwise(F.col("row_ix")))
    with pytest.raises(Exception, match="1048576"):
        spreadsheet.write_workbook(bad, path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["book.xlsx"]


def test_strings_of_other_writers(spark, tmp_path):
    """Shared strings with runs, numbers, booleans, formulas, cells and rows without references."""
    path, main = f"{tmp_path}/other.xlsx", spreadsheet._MAIN
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{spreadsheet._REL}"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AB2"><v>1.5</v></c></row><row><c t="b"><v>1</v></c><c t="s"><v>0</v></c><c t="str"><f>A1</f><v>made</v></c><c/></row></sheetData></worksheet>')
    got = {(r["row_ix"], r["col_ix"], r["value"]) for r in spreadsheet.read_cells(spark, path).collect()}
    assert got == {(1, 1, "two runs"), (1, 27, "1.5"), (2, 0, "TRUE"), (2, 1, "plain"), (2, 2, "made")}


def test_tables_as_sheets(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    made = spark.createDataFrame([(2, ["x"], None), (1, [], "t")], "id int, names array<string>, title string")
    spreadsheet.write_workbook(spreadsheet.table_rows(made, "Made", 0, [F.col("id")]), path)
    assert [tuple(r) for r in spreadsheet.read_sheet(spark, path, "Made").collect()] == [(1, "1", "[]", "t"), (2, "2", '["x"]', None)]
