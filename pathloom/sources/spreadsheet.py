"""Spreadsheets (.xlsx) as a Spark data source: zipped XML by the standard library, a partition a sheet, a commit.

Reading: ``spark.read.format("workbook").load(path)`` gives the cells of all sheets (``sheet``,
``row_ix``, ``col_ix``, ``value``; numbers from 0); with ``.option("sheet", name)`` one sheet as a
table of texts under its header row (``skip`` rows before it are passed over; ``row_ix`` is the
row's number in the sheet).  Writing takes rows (``place``, ``sheet``, ``row_ix``, ``values``,
``links``, ``heads``): see ``write_workbook``.  A sheet holds at most ``MOST_ROWS`` rows, the format's
limit, and is one task; the sheets are written side by side as parts, and the commit joins them into
one file that is put in place whole, so a lost executor or a failed job leaves no broken workbook.

Paths are of a file system that driver and executors have mounted.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.graph import placed

#: The format's limits: rows of a sheet, letters of a sheet's name.
MOST_ROWS, MOST_NAME = 1_048_576, 31
#: Column widths follow the header's length within these bounds.
LEAST_WIDTH, MOST_WIDTH = 10, 40
CELLS = "sheet string, row_ix int, col_ix int, value string"

# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def local_path(path: str) -> str:
    """The mounted path of a ``file:`` address or plain path."""
    plain = re.sub(r"^file:/*", "/", path)
    if re.match(r"^[a-z][a-z0-9+.-]+:", plain):
        raise ValueError(f"workbooks are read and written on mounted file systems, not at {path}")
    return plain


def column_letters(ix: int) -> str:
    """A, B, ... Z, AA, ... for 0, 1, ..."""
    letters, ix = "", ix + 1
    while ix:
        ix, rest = divmod(ix - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _column_number(reference: str) -> int:
    number = 0
    for c in reference:
        if not c.isalpha():
            break
        number = number * 26 + ord(c) - 64
    return number - 1


# Reading.


def sheet_parts(path: str) -> list[tuple[str, str]]:
    """(name, part within the file) of the sheets in their order."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
        return [(s.get("name"), _part_name(targets[s.get(f"{{{_REL}}}id")])) for s in sheets]


def _part_name(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _texts(element: ElementTree.Element) -> str:
    """The text of a string with or without runs; phonetic readings left out."""
    runs = [element, *element.findall(f"{{{_MAIN}}}r")]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{{{_MAIN}}}t"))


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{{{_MAIN}}}si")]


def sheet_rows(path: str, part: str) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(row, [(column, value)]) of a sheet, cells without a value left out; the part is read as a stream."""
    with zipfile.ZipFile(path) as z:
        shared, at = _shared(z), -1
        with z.open(part) as source:
            for _, element in ElementTree.iterparse(source):
                if element.tag != f"{{{_MAIN}}}row":
                    continue
                at, cells, col = int(element.get("r", at + 2)) - 1, [], -1
                for cell in element.findall(f"{{{_MAIN}}}c"):
                    col = _column_number(cell.get("r")) if cell.get("r") else col + 1
                    value, kind = cell.find(f"{{{_MAIN}}}v"), cell.get("t")
                    if kind == "inlineStr":
                        text = _texts(cell.find(f"{{{_MAIN}}}is"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text
                    cells.append((col, text))
                element.clear()
                yield at, cells


@dataclass
class _Sheet(InputPartition):
    name: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.sheet, self.skip, self.schema = local_path(options["path"]), options.get("sheet"), int(options.get("skip", 0)), schema

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(n, p) for n, p in sheet_parts(self.path) if self.sheet in (None, n)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        if self.sheet is None:
            for row, cells in sheet_rows(self.path, partition.part):
                for col, value in cells:
                    yield partition.name, row, col, value
            return
        names = None
        for row, cells in sheet_rows(self.path, partition.part):
            if row < self.skip or not cells:
                continue
            if names is None:
                names = {text: col for col, text in reversed(cells)}
                continue
            values = dict(cells)
            yield tuple(row if f.name == "row_ix" else values.get(names.get(f.name, -1)) for f in self.schema.fields)


# Writing.


@dataclass
class _Part:
    place: int
    sheet: str
    path: str
    rows: int
    columns: int


@dataclass
class _Parts(WriterCommitMessage):
    parts: list[_Part]


class _SheetFile:
    """A sheet's rows as XML, written as they come; what must stand before them is written first, what follows at the end."""

    def __init__(self, folder: str, place: int, sheet: str, first: tuple) -> None:
        self.part = _Part(place, sheet, f"{folder}/{uuid.uuid4().hex}.xml", 0, 0)
        self.out = open(self.part.path, "w", encoding="utf-8")  # noqa: SIM115
        widths = [max(LEAST_WIDTH, min(len(v or "") + 2, MOST_WIDTH)) for v in first]
        cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
        self.out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>')

    def add(self, row_ix: int, values: list[str | None], links: list[str | None] | None, head: bool) -> None:
        if row_ix >= MOST_ROWS:
            raise ValueError(f"a sheet holds {MOST_ROWS} rows; {self.part.sheet} has more")
        cells = []
        for col, value in enumerate(values):
            if value is None:
                continue
            where, style = f"{column_letters(col)}{row_ix + 1}", ' s="1"' if head else ""
            text = escape(_ILLEGAL.sub("", value))
            link = links[col] if links and col < len(links) else None
            if link:
                formula = escape('HYPERLINK("{}","{}")'.format(link.replace('"', '""'), _ILLEGAL.sub("", value).replace('"', '""')))
                cells.append(f'<c r="{where}" t="str" s="2"><f>{formula}</f><v>{text}</v></c>')
            else:
                cells.append(f'<c r="{where}"{style} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        self.out.write(f'<row r="{row_ix + 1}">{"".join(cells)}</row>')
        self.part.rows, self.part.columns = row_ix + 1, max(self.part.columns, len(values))

    def close(self, filtered: bool) -> _Part:
        area = f"A1:{column_letters(max(0, self.part.columns - 1))}{self.part.rows}"
        self.out.write(f"</sheetData>{f'<autoFilter ref={quoteattr(area)}/>' if filtered and self.part.rows > 1 else ''}</worksheet>")
        self.out.close()
        return self.part


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.filtered = local_path(options["path"]), options.get("filter", "true") == "true"
        self.folder = f"{self.path}._parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Parts:
        os.makedirs(self.folder, exist_ok=True)
        done, open_ = [], None
        for row in iterator:
            if open_ is None or open_.part.sheet != row["sheet"]:
                if open_ is not None:
                    done.append(open_.close(self.filtered))
                open_ = _SheetFile(self.folder, row["place"], row["sheet"], row["values"])
            open_.add(row["row_ix"], row["values"], row["links"], row["head"])
        if open_ is not None:
            done.append(open_.close(self.filtered))
        return _Parts(done)

    def commit(self, messages: list[_Parts | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.place, p.sheet))
        made = f"{self.folder}.xlsx"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            sheets = "".join(f'<sheet name={quoteattr(p.sheet)} sheetId="{i}" r:id="rId{i}"/>' for i, p in enumerate(parts, 1))
            relations = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1))
            relations += f'<Relationship Id="rId{len(parts) + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(parts) + 1))
            head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{types}</Types>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{relations}</Relationships>')
            z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{_MAIN}"><fonts count="3"><font/><font><b/></font><font><u/><color rgb="FF0563C1"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>')
            for i, part in enumerate(parts, 1):
                z.write(part.path, f"xl/worksheets/sheet{i}.xml")
        os.replace(made, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[_Parts | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class WorkbookSource(DataSource):
    """The data source ``workbook``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType | str:
        sheet = self.options.get("sheet")
        if sheet is None:
            return CELLS
        path = local_path(self.options["path"])
        part = next((p for n, p in sheet_parts(path) if n == sheet), None)
        if part is None:
            raise ValueError(f"{path} has no sheet {sheet!r}; there are {', '.join(n for n, _ in sheet_parts(path))}")
        skip = int(self.options.get("skip", 0))
        header = next((cells for row, cells in sheet_rows(path, part) if row >= skip and cells), [])
        return StructType([StructField("row_ix", IntegerType()), *[StructField(n, StringType()) for n in dict.fromkeys(text for _, text in header)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not overwrite and os.path.exists(local_path(self.options["path"])):
            raise ValueError(f"{self.options['path']} is there already")
        return _Writer(self.options)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all sheets of a workbook."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: dict[str, str] | None = None, skip: int = 0) -> DataFrame:
    """One sheet as a table of texts with ``row_ix``; ``columns``: names to keep and what they become.

    A column that is asked for and not there is an error.
    """
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("sheet", sheet).option("skip", skip).load(path)
    return rows if columns is None else rows.select("row_ix", *[F.col(f"`{name}`").alias(to) for name, to in columns.items()])


def write_workbook(rows: DataFrame, path: str, overwrite: bool = True, auto_filter: bool = True) -> None:
    """Rows ``place`` (of the sheet), ``sheet``, ``row_ix`` (from 0), ``values``, and if wanted ``links`` (an address for each value) and ``head`` (bold; else row 0 is).

    Names of sheets are cut to the format's limit; two that become one are an error of the caller.
    """
    spark = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    has = rows.columns
    ready = rows.select(
        F.col("place").cast("int").alias("place"), F.substring("sheet", 1, MOST_NAME).alias("sheet"), F.col("row_ix").cast("int").alias("row_ix"), F.col("values").cast("array<string>").alias("values"),
        (F.col("links") if "links" in has else F.lit(None)).cast("array<string>").alias("links"), (F.col("head") if "head" in has else F.col("row_ix") == 0).alias("head"),
    )
    dealt = ready.repartition("place", "sheet").sortWithinPartitions("place", "sheet", "row_ix")
    dealt.write.format("workbook").mode("overwrite" if overwrite else "append").option("filter", str(auto_filter).lower()).save(path)


def table_rows(df: DataFrame, sheet: str, place: int, order: list) -> DataFrame:
    """A table as rows of a sheet: the header, then its rows in order, all as texts (lists and structures as JSON)."""
    shown = [F.to_json(f"`{n}`") if t.startswith(("array", "map", "struct")) else F.col(f"`{n}`").cast("string") for n, t in df.dtypes]
    body = placed(df, order, "_place").select(F.lit(place).alias("place"), F.lit(sheet).alias("sheet"), F.col("_place").cast("int").alias("row_ix"), F.array(*shown).alias("values"))
    head = df.sparkSession.range(1).select(F.lit(place).alias("place"), F.lit(sheet).alias("sheet"), F.lit(0).alias("row_ix"), F.array(*map(F.lit, df.columns)).alias("values"))
    return head.unionByName(body)
