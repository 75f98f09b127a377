"""Rows of the tables of HTML pages: whole rows in Arrow batches, cells with their links, classes and headings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "section string, subsection string, table_index int, table_classes array<string>, row_index int, cells array<string>, links array<struct<text: string, title: string, href: string>>"
_TYPES = [
    ("section", pa.string()), ("subsection", pa.string()), ("table_index", pa.int32()), ("table_classes", pa.list_(pa.string())), ("row_index", pa.int32()), ("cells", pa.list_(pa.string())),
    ("links", pa.list_(pa.struct([("text", pa.string()), ("title", pa.string()), ("href", pa.string())]))),
]
#: Headings that name a section and its parts (fixed values).
SECTION, PARTS = "h2", ("h3", "h4")
UNSECTIONED = "Unsectioned"


def _clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class _Table:
    def __init__(self, index: int, classes: list[str], section: str, subsection: str | None):
        self.index, self.classes, self.section, self.subsection = index, classes, section, subsection
        self.seen = 0  # rows below it, nested ones too: a row's number counts them all
        self.row: dict | None = None


class _Tables(HTMLParser):
    """Collects rows with their direct cells; a nested table's text belongs to the cell around it, its rows to itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[_Table] = []
        self.count = 0
        self.section, self.subsection = UNSECTIONED, None
        self.heading: str | None = None
        self.text: list[str] = []
        self.anchors: list[tuple[dict, list[str]]] = []
        self.quiet = 0

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == SECTION or tag in PARTS:
            self._close_heading()
            self.heading, self.text = tag, []
        elif tag == "table":
            self.count += 1
            self.open.append(_Table(self.count, (names.get("class") or "").split(), self.section, self.subsection))
        elif tag == "tr" and self.open:
            self._close_row()
            for t in self.open:
                t.seen += 1
            self.open[-1].row = {"index": self.open[-1].seen - 1, "cells": [], "links": [], "open": False}
        elif tag in ("td", "th") and self.open and self.open[-1].row is not None:
            self.open[-1].row["cells"].append([])
            self.open[-1].row["open"] = True
        elif tag == "a":
            self.anchors.append((names, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == self.heading:
            self._close_heading()
        elif tag == "a" and self.anchors:
            self._close_anchor()
        elif tag in ("td", "th") and self.open and self.open[-1].row is not None:
            self.open[-1].row["open"] = False
        elif tag == "tr" and self.open:
            self._close_row()
        elif tag == "table" and self.open:
            self._close_row()
            self.open.pop()

    def handle_data(self, data):
        if self.quiet:
            return
        if self.heading:
            self.text.append(data)
        for _, text in self.anchors:
            text.append(data)
        for t in self.open:
            if t.row is not None and t.row["open"]:
                t.row["cells"][-1].append(data)

    def _close_heading(self):
        if self.heading:
            text = _clean(self.text)
            if self.heading == SECTION:
                self.section, self.subsection = text, None
            else:
                self.subsection = text
        self.heading = None

    def _close_anchor(self):
        names, parts = self.anchors.pop()
        link = {"text": _clean(parts), "title": _clean([names.get("title") or ""]), "href": names.get("href") or ""}
        if link["text"] or link["title"]:
            for t in self.open:
                if t.row is not None:
                    t.row["links"].append(link)

    def _close_row(self):
        t = self.open[-1]
        if t.row is not None:
            cells = [_clean(c) for c in t.row["cells"]]
            if any(cells):
                self.rows.append((t.section, t.subsection, t.index, t.classes, t.row["index"], cells, t.row["links"]))
        t.row = None

    def finish(self) -> list[tuple]:
        while self.anchors:
            self._close_anchor()
        while self.open:
            self._close_row()
            self.open.pop()
        return sorted(self.rows, key=lambda r: (r[2], r[4]))


def parse(html: str | None) -> list[tuple]:
    """The rows of one page, by table and row; what is left open at the end of the page is closed."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser.finish()


#: Rows that leave a task at once.
OUT = 2_000


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.select(batch.schema.names[1:])
        at: list[int] = []
        made: list[tuple] = []

        def flush(kept=kept, at=at, made=made):
            columns = list(zip(*made, strict=True)) if made else [[]] * len(_TYPES)
            arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, _TYPES, strict=True)]
            given = kept.take(pa.array(at, pa.int64()))
            out = pa.RecordBatch.from_arrays([*given.columns, *arrays], [*given.schema.names, *[n for n, _ in _TYPES]])
            at.clear()
            made.clear()
            return out

        for i, html in enumerate(batch.column(0)):
            rows = parse(html.as_py())
            made += rows
            at += [i] * len(rows)
            if len(made) >= OUT:
                yield flush()
        yield flush()


def table_rows(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(keep, ROW): each table row with a cell that is not empty.

    Cells are the row's own (text of tables inside them included); a nested table's rows
    are its own and have its number.  section is the last h2 before the table, or
    `Unsectioned`; subsection the last h3 or h4 after that h2.  A null page has no rows.
    Kept columns pass as Arrow columns; names that they share with ROW get an underscore.
    """
    taken = {n for n, _ in _TYPES}
    names = [f"{c}_" if c in taken else c for c in keep]
    given = pages.select(F.col(html).alias("_html"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    return given.mapInArrow(_run, f"{schema + ', ' if schema else ''}{ROW}")
