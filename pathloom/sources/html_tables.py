"""Tables in HTML: a row for each cell (``html_cells``) or for each row of a table (``html_rows``), also as a table function.

A table's headers are all its ``th`` cells, else the cells of its first row; short rows are padded
and long ones cut; of two columns with one header the later counts.  A nested table is a table of its
own, and its rows and cells also belong to the tables around it.  Texts are the stripped pieces of a
cell, one behind the other.  A cell that holds a list of ``<li><span>key</span>value`` items also has
them as ``Key: value; ...`` (``listed``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = "table_ix int, row_ix int, col_ix int, header string, value string, listed string"


class _Page(NamedTuple):
    """The pieces of text of a page in order, as they are and stripped.  Cells, items and spans hold their numbers."""

    texts: list[str]
    stripped: list[str]


class _Cell:
    __slots__ = ("items", "lists", "pieces")

    def __init__(self) -> None:
        self.pieces: list[int] = []
        self.lists = 0
        self.items: list[_Item] = []

    def text(self, page: _Page) -> str:
        return "".join([page.stripped[p] for p in self.pieces])

    def listed(self, page: _Page) -> str | None:
        """The first list's items that have a key; None for a cell without a list."""
        if not self.lists:
            return None
        found = {}
        for item in self.items:
            if item.spans:
                span = [t for p in item.spans[0] if (t := page.texts[p])]
                key = ":".join(span).strip().lower().replace(" ", "_")
                found[key] = "".join([page.texts[p] for p in item.pieces]).replace("".join(span), "").strip()
        return "; ".join([f"{key.replace('_', ' ').title()}: {value}" for key, value in found.items()])


class _Item:
    """A list item: its pieces of text, and those of its spans."""

    __slots__ = ("pieces", "spans")

    def __init__(self) -> None:
        self.pieces: list[int] = []
        self.spans: list[list[int]] = []


class _Table:
    def __init__(self) -> None:
        self.headers: list[_Cell] = []
        self.rows: list[list[_Cell]] = []

    def columns(self, page: _Page) -> tuple[dict[str, int], list[list[_Cell]]]:
        """Headers in order, each with the place of the cell that counts, and the rows below them that have cells."""
        headers, rows = [h.text(page) for h in self.headers], self.rows
        if not headers and rows:
            headers, rows = [c.text(page) for c in rows[0]], rows[1:]
        return {header: at for at, header in enumerate(headers)}, [row for row in rows if row]


#: Elements that tables are built of.
_BUILDS = frozenset("table tr td th ul li span".split())


class _Tables:
    """All tables of a text.  Tags stay open until an end tag of their name comes; such a tag closes all within.

    What is open is kept by kind as well, so that no tag or text looks through the whole stack.
    """

    def __init__(self) -> None:
        self.tables: list[_Table] = []
        self.names: list[str] = []
        self.closing: list[tuple[list, ...]] = []
        self.open_tables: list[_Table] = []
        self.open_rows: list[list[_Cell]] = []
        self.open_cells: list[_Cell] = []
        self.open_items: list[_Item] = []
        self.first_lists: list[bool] = []
        self.holders: list[list[int]] = []

    def start(self, tag: str) -> None:
        closing: tuple[list, ...] = ()
        if tag not in _BUILDS:
            pass
        elif tag == "td" or tag == "th":
            cell = _Cell()
            if tag == "td":
                for row in self.open_rows:
                    row.append(cell)
            else:
                for table in self.open_tables:
                    table.headers.append(cell)
            self.open_cells.append(cell)
            self.holders.append(cell.pieces)
            closing = (self.open_cells, self.holders)
        elif tag == "tr":
            row = []
            for table in self.open_tables:
                table.rows.append(row)
            self.open_rows.append(row)
            closing = (self.open_rows,)
        elif tag == "table":
            table = _Table()
            self.tables.append(table)
            self.open_tables.append(table)
            closing = (self.open_tables,)
        elif tag == "ul":
            first = False
            for cell in self.open_cells:
                cell.lists += 1
                first = first or cell.lists == 1
            if first:
                self.first_lists.append(first)
                closing = (self.first_lists,)
        elif tag == "li" and self.first_lists:
            item = _Item()
            for cell in self.open_cells:
                cell.items.append(item)
            self.open_items.append(item)
            self.holders.append(item.pieces)
            closing = (self.open_items, self.holders)
        elif tag == "span" and self.open_items:
            pieces: list[int] = []
            for item in self.open_items:
                item.spans.append(pieces)
            self.holders.append(pieces)
            closing = (self.holders,)
        if tag not in _VOID:
            self.names.append(tag)
            self.closing.append(closing)

    def end(self, tag: str) -> None:
        names, closing = self.names, self.closing
        if tag in names:
            while True:
                for kind in closing.pop():
                    kind.pop()
                if names.pop() == tag:
                    break

    def text(self, piece: int) -> None:
        for holder in self.holders:
            holder.append(piece)


class _Parser(HTMLParser):
    """Any HTML, as the standard library reads it."""

    def __init__(self, into: _Tables) -> None:
        super().__init__()
        self.into = into
        self.piece: list[str] = []
        self.texts: list[str] = []

    def _flush(self) -> None:
        if self.piece:
            self.into.text(len(self.texts))
            self.texts.append("".join(self.piece))
            self.piece = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        self.into.start(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        self.into.end(tag)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        self.piece.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


#: A plain tag: a name of letters and digits, attributes in double quotes.  Here every parser sees the same.
_PLAIN = re.compile(r'<(/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"<>]*")*[ \t\r\n]*/?)>')
_NAME = re.compile(r"[a-zA-Z0-9]+")
#: Elements whose content some parsers read as text.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())


def _laid_out(tags: tuple[str, ...]) -> list[_Table] | None:
    """The tables that these plain tags make, whatever texts stand between them; None with raw elements."""
    found = _Tables()
    for at, raw in enumerate(tags):
        tag = _NAME.search(raw).group().lower()
        if tag in _RAW:
            return None
        found.text(at)
        if raw[0] == "/":
            found.end(tag)
        else:
            found.start(tag)
            if raw[-1] == "/" and tag not in _VOID:
                found.end(tag)
    found.text(len(tags))
    return found.tables


#: Layouts of so many pages are kept, of pages of so many tags at most: pages of one template share theirs.
_LAYOUTS, _MOST_TAGS = 256, 2_000
_known_layout = lru_cache(_LAYOUTS)(_laid_out)


def _tables(html: str | None) -> tuple[_Page, list[_Table]]:
    """The tables of a text, by plain tags where it has no others, else as the standard library parses it."""
    text = unescape(html or "")
    parts = _PLAIN.split(text)
    tables = None
    if text.count("<") * 2 + 1 == len(parts):
        tags = tuple(parts[1::2])
        tables = _known_layout(tags) if len(tags) <= _MOST_TAGS else _laid_out(tags)
    if tables is not None:
        texts = [unescape(t) if "&" in t else t for t in parts[::2]]
    else:
        found = _Tables()
        parser = _Parser(found)
        parser.feed(text)
        parser.close()
        texts, tables = parser.texts, found.tables
    return _Page(texts, [t.strip() for t in texts]), tables


def table_cells(html: str | None) -> Iterator[tuple[int, int, int, str, str, str | None]]:
    """(table, row, column, header, value, listed) of all cells under a header."""
    page, tables = _tables(html)
    for t, table in enumerate(tables):
        headers, rows = table.columns(page)
        for r, row in enumerate(rows):
            for c, (header, at) in enumerate(headers.items()):
                cell = row[at] if at < len(row) else None
                yield t, r, c, header, cell.text(page) if cell else "", cell.listed(page) if cell else None


@F.udtf(returnType=CELLS)
class HtmlTables:
    """The table function: cells of all tables of a text."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        yield from table_cells(html)


_CELL = pa.struct([("col_ix", pa.int32()), ("header", pa.string()), ("value", pa.string()), ("listed", pa.string())])


def _rows_of(pages: Iterator[tuple[int, str | None]]) -> tuple[list[int], pa.RecordBatch]:
    """The rows of all tables of some pages, each with its cells; and the page that each is from."""
    at, tables, rows, ends = [], [], [], [0]
    columns, headers, values, listed = [], [], [], []
    for number, html in pages:
        page, made = _tables(html)
        for t, table in enumerate(made):
            named, found = table.columns(page)
            places = list(named.values())
            if not places:
                continue
            for r, row in enumerate(found):
                at.append(number)
                tables.append(t)
                rows.append(r)
                columns.extend(range(len(places)))
                headers.extend(named)
                size = len(row)
                for place in places:
                    cell = row[place] if place < size else None
                    values.append(cell.text(page) if cell else "")
                    listed.append(cell.listed(page) if cell and cell.lists else None)
                ends.append(len(columns))
    cells = pa.StructArray.from_arrays([pa.array(columns, pa.int32()), pa.array(headers, pa.string()), pa.array(values, pa.string()), pa.array(listed, pa.string())], fields=list(_CELL))
    return at, pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()), pa.array(rows, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], ["table_ix", "row_ix", "cells"])


#: Characters of HTML that are parsed before their rows are handed on; bytes that are sent to Python at a time.
_SLICE, _BATCH_BYTES = 1 << 20, 16 << 20


def html_rows(pages: DataFrame, key: list[str], html_col: str) -> DataFrame:
    """The rows of all tables of a column of HTML, each with its ``cells`` and the key columns; nothing is shuffled."""
    held = F.contains(F.lower(html_col), F.lit("<table")) | F.contains(F.lower(html_col), F.lit("&lt;table"))
    rows = pages.filter(held).select(*key, F.col(html_col).alias("_html"))
    schema = StructType([*[rows.schema[k] for k in key], *StructType.fromDDL("table_ix int, row_ix int, cells array<struct<col_ix: int, header: string, value: string, listed: string>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, size = [], 0
            for at, html in enumerate(batch.column("_html")):
                pages.append((at, html.as_py()))
                size += len(pages[-1][1])
                if size >= _SLICE or at + 1 == batch.num_rows:
                    where, found = _rows_of(iter(pages))
                    if found.num_rows:
                        keys = [batch.column(k).take(pa.array(where, pa.int64())) for k in key]
                        yield pa.RecordBatch.from_arrays([*keys, *found.columns], [*key, *found.schema.names])
                    pages, size = [], 0

    # Batches by bytes: ten thousand long pages would be held at once by each task.
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def html_cells(pages: DataFrame, key: list[str], html_col: str) -> DataFrame:
    """The cells of all tables of a column of HTML, with the key columns of their rows."""
    return html_rows(pages, key, html_col).select(*key, "table_ix", "row_ix", F.inline("cells"))


def row_frame(rows: DataFrame, key: list[str], headers: list[str], listed: list[int] | None = None) -> DataFrame:
    """As ``table_frame``, from the rows themselves (``html_rows``): no row is put together again."""
    shown = lambda x: F.when(x["col_ix"].isin(*(listed or [])), F.coalesce(x["listed"], x["value"])).otherwise(x["value"]) if listed else x["value"]
    named = lambda h: F.filter("cells", lambda x: x["header"] == h)
    return rows.select(*key, "table_ix", "row_ix", *[F.coalesce(F.get(F.transform(named(h), shown), F.lit(0)), F.lit("")).alias(h) for h in headers])


def table_frame(cells: DataFrame, key: list[str], headers: list[str], listed: list[int] | None = None) -> DataFrame:
    """One row for each row of a table, a column for each header named; ``listed``: columns whose lists are written out as keys and values."""
    shown = F.when(F.col("col_ix").isin(*(listed or [])), F.coalesce("listed", "value")).otherwise(F.col("value")) if listed else F.col("value")
    columns = [F.coalesce(F.max(F.when(F.col("header") == h, shown)), F.lit("")).alias(h) for h in headers]
    return cells.groupBy(*key, "table_ix", "row_ix").agg(*columns)
