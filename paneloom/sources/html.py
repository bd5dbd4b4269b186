"""Tables out of HTML pages: parsing runs in the executors, one page at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "table_id string, row_ord int, names array<string>, cells array<string>"


#: Comments, scripts and the tags that shape a table; all other tags only separate pieces of text.
_TOKEN = re.compile(
    r"""<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)(table|tr|td|th|br)\b((?:[^>"']|"[^"]*"|'[^']*')*+)>""",
    re.IGNORECASE | re.DOTALL,
)
_TAG = re.compile(r"<[^>]*>")
_ATTRIBUTE = re.compile(r"""\b(id|colspan|rowspan)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def _attributes(text: str) -> dict[str, str]:
    return {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(text)} if text else {}


def _span(value: str | None) -> int:
    return int(value) if value and value.isdigit() and int(value) > 0 else 1


class _Grid:
    """Rows of one table; a cell is repeated over its column and row span."""

    def __init__(self, table_id: str | None):
        self.table_id = table_id
        self.rows: list[list[str | None]] = []
        self.row: list[str | None] | None = None
        self.text: list[str] | None = None
        self.span = (1, 1)
        # Cells reaching down: column -> (text, rows left), for this row and for the next one.
        self.held: dict[int, tuple[str | None, int]] = {}
        self.next: dict[int, tuple[str | None, int]] = {}

    def start_cell(self, attributes: str) -> None:
        self.end_cell()
        if self.row is None:
            self.row = []
        given = _attributes(attributes)
        self.span = _span(given.get("colspan")), _span(given.get("rowspan"))
        self.text = []

    def end_cell(self) -> None:
        if self.text is None:
            return
        text = "".join(self.text)
        if "<" in text:
            text = _TAG.sub("", text)
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split()) or None
        self.text = None
        self.fill()
        across, down = self.span
        for _ in range(across):
            if down > 1:
                self.next[len(self.row)] = (text, down - 1)
            self.row.append(text)

    def fill(self) -> None:
        while len(self.row) in self.held:
            text, more = self.held.pop(len(self.row))
            if more > 1:
                self.next[len(self.row)] = (text, more - 1)
            self.row.append(text)

    def start_row(self) -> None:
        self.end_row()
        self.row = []

    def end_row(self) -> None:
        self.end_cell()
        if self.row is None:
            return
        self.fill()
        self.rows.append(self.row)
        self.row = None
        self.held, self.next = self.next, {}


def parse_tables(html: str | None) -> list[tuple[str | None, list[list[str | None]]]]:
    """Every table of a page as (id, rows), in document order."""
    grids: list[_Grid] = []
    nested: list[_Grid] = []
    last = 0
    for token in _TOKEN.finditer(html or ""):
        grid = nested[-1] if nested else None
        if grid is not None and grid.text is not None:
            grid.text.append(html[last : token.start()])
        last = token.end()
        _, closing, tag, attributes = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "table" and not closing:
            grids.append(_Grid(_attributes(attributes).get("id")))
            nested.append(grids[-1])
        elif grid is None:
            continue
        elif tag == "table":
            grid.end_row()
            nested.pop()
        elif tag == "tr":
            grid.end_row() if closing else grid.start_row()
        elif tag == "br":
            if grid.text is not None:
                grid.text.append(" ")
        elif closing:
            grid.end_cell()
        else:
            grid.start_cell(attributes)
    for grid in nested:
        grid.end_row()
    return [(g.table_id, g.rows) for g in grids]


def html_tables(
    pages: DataFrame,
    table_ids: Sequence[str] | None = None,
    *,
    header_row: int = 0,
    html: str = "html",
    missing: str = "raise",
) -> DataFrame:
    """Rows of one table per page: the first of ``table_ids`` that the page has, else its first table.

    Keeps the other columns of ``pages`` and adds ``table_id``, ``row_ord``, ``names`` (the cells of row
    ``header_row``, upper-cased) and ``cells``; rows up to the header are left out. A page without the table is an
    error, or is left out with ``missing="skip"``, or gives one row without cells with ``missing="mark"``.
    """
    if missing not in ("raise", "skip", "mark"):
        raise ValueError("missing must be 'raise', 'skip' or 'mark'")
    ids = list(table_ids) if table_ids is not None else None
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in kept]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, found_ids, places, heads, lines = [], [], [], [], []
            for at, document in enumerate(batch.column(html).to_pylist()):
                found = _choose(parse_tables(document), ids)
                if found is None or len(found[1]) <= header_row:
                    if missing == "raise":
                        raise ValueError(f"no table {ids or ''} in page {batch.slice(at, 1).select(names).to_pylist()}")
                    if missing == "skip":
                        continue
                    table_id, rows, head = None, [None], None
                    first = None
                else:
                    table_id, rows = found[0], found[1][header_row + 1 :]
                    head = [c and c.upper() for c in found[1][header_row]]
                    first = header_row + 1
                origin += [at] * len(rows)
                found_ids += [table_id] * len(rows)
                places += [None if first is None else first + i for i in range(len(rows))]
                heads += [head] * len(rows)
                lines += rows
            about = batch.select(names).take(pa.array(origin, pa.int32()))
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *about.columns, pa.array(found_ids, pa.string()), pa.array(places, pa.int32()),
                    pa.array(heads, texts), pa.array(lines, texts),
                ],
                [*names, "table_id", "row_ord", "names", "cells"],
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select(*names, html).mapInArrow(parse, f"{columns}, {ROWS}")


def _choose(tables: list, ids: list[str] | None):
    """The first table, or the first of ``ids`` that occurs."""
    if ids is None:
        return tables[0] if tables else None
    return next((t for i in ids for t in tables if t[0] == i), None)


def cell(name: str) -> Column:
    """Cell under the header ``name`` (case ignored), null when the table has no such column."""
    at = F.nullif(F.array_position("names", name.upper()), F.lit(0)).cast("int")
    return F.try_element_at("cells", at)


def has_column(name: str) -> Column:
    """Whether the table has a column with the header ``name``."""
    return F.array_position("names", name.upper()) > 0


def header_names(rows: DataFrame) -> list[str]:
    """Distinct header names, in the order of their first place (a bounded list)."""
    # One header per table and page is enough; the rows of a page repeat it.
    named = rows.select("names").distinct().select(F.posexplode("names").alias("at", "name"))
    first = named.where("name IS NOT NULL").groupBy("name").agg(F.min("at").alias("at"))
    return [r.name for r in first.orderBy("at", "name").collect()]
