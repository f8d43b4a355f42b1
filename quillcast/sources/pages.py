"""Rows of HTML tables and lists in a table of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "page_id long, table_id string, table_ix int, row_ix int, cells array<string>, links array<string>, anchors array<string>, stats array<string>, error string"


class _Tables(HTMLParser):
    """All body rows: (table id, table number, row number, row class, cells). Of a cell: its first text, trimmed, the target
    and first text of its first link, and its data-stat."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.table, self.id, self.row, self.cell, self.link = -1, "", None, False, False
        self.n = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table, self.id, self.n, self.row = self.table + 1, a.get("id") or "", 0, None
        elif tag == "tr" and self.table >= 0:
            self.close_row()
            self.row, self.kind = [], a.get("class") or ""
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([None, None, None, a.get("data-stat")])
            self.cell, self.link = True, False
        elif tag == "a" and self.cell and self.row and self.row[-1][1] is None:
            self.row[-1][1], self.link = a.get("href") or "", True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = False
        elif tag in ("tr", "table"):
            self.close_row()
        elif tag == "a":
            self.link = False

    def handle_data(self, data):
        if self.cell and self.row and data.strip():
            for k in (0, 2) if self.link else (0,):
                if self.row[-1][k] is None:
                    self.row[-1][k] = data.strip()

    def close_row(self):
        if self.row is not None:
            self.rows.append((self.id, self.table, self.n, self.kind, self.row))
            self.n += 1
        self.row, self.cell, self.link = None, False, False


def table_rows(pages: DataFrame, least: int = 1) -> DataFrame:
    """(page_id, table_id, table_ix, row_ix, cells, links, anchors, stats, error) of pages(page_id, html).

    links, anchors and stats have an element for each cell: target and text of its first link, and its data-stat, or
    null. Rows of class `thead` and rows with fewer than `least` cells are skipped. A page without a table has no
    rows; a page that can't be read has one row with `error` instead of stopping the job."""

    def rows_of(page, text):
        try:
            t = _Tables()
            t.feed(text or "")
            t.close()
            t.close_row()
        except Exception as e:
            yield page, None, None, None, None, None, None, None, str(e)
            return
        for i, k, n, kind, cells in t.rows:
            if "thead" not in kind.split() and len(cells) >= least:
                yield page, i, k, n, [c[0] or "" for c in cells], [c[1] for c in cells], [c[2] for c in cells], [c[3] for c in cells], None

    texts = pa.list_(pa.string())
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), texts, texts, texts, texts, pa.string()]
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(batch), 256):
                found = [r for k in range(at, min(at + 256, len(batch))) for r in rows_of(ids[k], batch.column(1)[k].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, ROW)


def list_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of the links that begin list items."""
    found = F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))
