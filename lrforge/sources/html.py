"""Links and likelihood-ratio tables from web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_REPORTED = "Not reported"
ROWS = "array<struct<finding:string,lr:string>>"


def nav_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, link_order, url, display_name) of list links, by regular expressions in the JVM."""
    found = F.regexp_extract_all(html_col, F.lit(r'<li><a href="([^"]*)">[^<]*</a>'), F.lit(0))
    each = pages.select(id_col, F.posexplode(found).alias("link_order", "tag"))
    return each.select(id_col, "link_order", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_extract("tag", r">([^<]*)</a>", 1)).alias("display_name"))


def heading_links(pages: DataFrame, heading: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links of the list that follows a third-level heading with this text."""
    block = F.regexp_extract(html_col, rf"(?s)<h3[^>]*>\s*\Q{heading}\E\s*</h3>\s*<ul[^>]*>(.*?)</ul>", 1)
    found = F.regexp_extract_all(block, F.lit(r'<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))
    each = pages.select(id_col, F.posexplode(found).alias("link_order", "tag"))
    return each.select(id_col, "link_order", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_extract("tag", r">([^<]*)</a>", 1)).alias("display_name"))


class _Tables(HTMLParser):
    """Collects rows of the ratio table in the details article, and all cells in order for pages without one."""

    def __init__(self):
        super().__init__()
        self.article = self.table = 0
        self.row: list[dict] | None = None
        self.cell: dict | None = None
        self.rows, self.cells, self.link = [], [], False

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag == "article":
            self.article += 1 if self.article or "lr_cards_details" in classes else 0
        elif tag == "table":
            self.table += 1 if self.table or (self.article and "lrtable" in classes) else 0
        elif tag == "tr":
            self.row = []
        elif tag == "td":
            self.cell = {"text": "", "link": ""}
        elif tag == "a":
            self.link = True

    def handle_endtag(self, tag):
        if tag == "article" and self.article:
            self.article -= 1
        elif tag == "table" and self.table:
            self.table -= 1
        elif tag == "a":
            self.link = False
        elif tag == "td" and self.cell is not None:
            text = " ".join((self.cell["link"] or self.cell["text"]).split())
            self.cells.append(text)
            if self.row is not None:
                self.row.append(text)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.table and len(self.row) == 2:
                self.rows.append(tuple(self.row))
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data
            if self.link:
                self.cell["link"] += data


def lr_rows(html: str | None) -> list[dict]:
    """Findings and ratios of a page; a blank ratio is not reported. Without the table, cells are paired in order."""
    parser = _Tables()
    parser.feed(html or "")
    pairs = parser.rows or list(zip(parser.cells[::2], parser.cells[1::2], strict=False))
    return [{"finding": f, "lr": lr or NOT_REPORTED} for f, lr in pairs if f]


def lr_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, finding_order, finding, lr) of pages with table cells."""

    @F.pandas_udf(ROWS)
    def parse(html: pd.Series) -> pd.Series:
        return html.map(lr_rows)

    some = pages.where(F.contains(html_col, F.lit("<td")))
    return some.select(id_col, F.posexplode(parse(html_col)).alias("finding_order", "r")).select(id_col, "finding_order", "r.finding", "r.lr")
