"""Structure out of HTML and JSON text: table functions for what expressions cannot say."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import MONTHS, strip_html
from tandem.operators.variants import walk as walk

#: Tags that open a block, and headings by level (fixed values).
HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = (*HEADINGS, "p", "li", "td", "th")


class _Blocks(HTMLParser):
    """Text blocks with the heading above them, and table rows with their direct cells and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.heading = {h: "" for h in HEADINGS}
        self.open: str | None = None
        self.text: list[str] = []
        self.links: list[str] = []
        self.skip = 0
        self.tables: list[list[int]] = []  # table number, row number
        self.seen_tables = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.close()  # what stands before a nested table belongs to the outer one
            self.seen_tables += 1
            self.tables.append([self.seen_tables, 0])
        elif tag == "tr" and self.tables:
            self.tables[-1][1] += 1
        if tag in BLOCKS:
            self.close()
            self.open = tag
        if tag == "a" and self.open:
            self.links += [v or "" for k, v in attrs if k == "href"]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.tables:
            self.close()
            self.tables.pop()
        if tag == self.open:
            self.close()

    def handle_data(self, data):
        if self.open and not self.skip:
            self.text.append(data)

    def close(self):
        text = " ".join("".join(self.text).split())
        if self.open and text:
            if self.open in HEADINGS:
                self.heading[self.open] = text
                for h in HEADINGS[HEADINGS.index(self.open) + 1 :]:
                    self.heading[h] = ""
            above = next((self.heading[h] for h in reversed(HEADINGS) if self.heading[h]), "")
            table, row = self.tables[-1] if self.tables else (0, 0)
            self.out.append((len(self.out), self.open, above, table, row, text, list(self.links)))
        self.open, self.text, self.links = None, [], []


@F.udtf(returnType="block int, tag string, heading string, table_index int, row_index int, text string, links array<string>")
class HtmlBlocks:
    """Blocks of a page in order, one row each."""

    def eval(self, html: str):
        if html:
            parser = _Blocks()
            parser.feed(html)
            parser.close()
            yield from parser.out


def _beside(rows: DataFrame, made: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """The kept columns of rows beside those that a table function made of each, whatever names they share."""
    return rows.alias("given").lateralJoin(made.alias("made")).select(*[F.col(f"given.`{c}`") for c in keep], *[F.col(f"made.{c}") for c in columns])


def blocks_of(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    return _beside(pages, HtmlBlocks(F.col(html).outer()), keep, ["block", "tag", "heading", "table_index", "row_index", "text", "links"])


def dated_items(html: Column) -> Column:
    """List items that begin with a date, `Month d, yyyy`: an array of (day, text) in page order."""
    months = "|".join(MONTHS)
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    pattern = rf"(?s)^\s*((?:{months}) \d{{1,2}}, \d{{4}})[\s:;,.–-]*(.*)$"
    parts = F.transform(items, lambda x: F.struct(F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.lit("MMMM d, yyyy"))).alias("day"), strip_html(F.regexp_extract(x, pattern, 2)).alias("text")))
    return F.filter(parts, lambda x: x["day"].isNotNull())


def matches_value(kind: Column, value: Column, wanted: float, tolerance: float = 1e-7) -> Column:
    """Is a walked scalar the wanted number?"""
    return kind.isin("int", "float") & (F.abs(value.try_cast("double") - wanted) <= tolerance)
