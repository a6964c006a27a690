"""Tables and text parts of landed pages by a walk over their tags.

The standard HTML parser reads each page once, a batch of pages at a time; a page's parts come out as
rows. Nested tables, missing end tags and any quoting of attributes are followed as a browser would:
a cell, row or table that is never closed ends with what holds it.
"""

from __future__ import annotations

import os
import pathlib
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SOURCE = str(pathlib.Path(__file__).resolve().parents[2])
MARKED = ("injury", "player", "status")
SCHEMA = "page_id bigint, url string, kind string, table_no int, row_no int, cells array<string>, content string"
UNSEEN = ("script", "style")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Walk(HTMLParser):
    """Collects text nodes, the rows of every table, and the text of tables and marked divs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, texts (or None), table number
        self.texts: list[str] = []
        self.rows: list[tuple[int, int, list[str]]] = []
        self.parts: list[tuple[str, str]] = []
        self.tables: list[dict] = []
        self.n_tables = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th", "tr"):
            self._end_until(("td", "th") if tag != "tr" else ("tr",), "table")
        if tag == "table":
            self.tables.append({"no": self.n_tables, "rows": 0, "cells": None})
            self.n_tables += 1
        elif tag == "tr" and self.tables:
            self.tables[-1]["cells"] = []
        if tag in VOID:
            return
        marked = tag == "div" and any(w in (v or "").lower() for k, v in attrs if k == "class" for w in MARKED)
        keeps = tag in ("table", "td", "th") or marked
        self.open.append([tag, [] if keeps else None])

    def _end_until(self, tags, fence):
        """Close the nearest open one of ``tags`` that is not outside of ``fence``."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in tags:
                return self._close(depth)
            if self.open[depth][0] == fence:
                return None
        return None

    def handle_endtag(self, tag):
        fence = "table" if tag in ("td", "th", "tr") else "td" if tag not in ("table", "div") else ""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                return self._close(depth)
            if self.open[depth][0] == fence:
                return None
        return None

    def _close(self, depth):
        while len(self.open) > depth:
            tag, texts = self.open.pop()
            content = " ".join(x for x in (t.strip() for t in texts or ()) if x)
            table = self.tables[-1] if self.tables else None
            if tag in ("td", "th") and table and table["cells"] is not None:
                table["cells"].append(content)
            elif tag == "tr" and table and table["cells"] is not None:
                table["rows"] += 1
                self.rows.append((table["no"], table["rows"], table["cells"]))
                table["cells"] = None
            elif tag == "table":
                self.parts.append(("table", content))
                self.tables.pop()
            elif tag == "div" and texts is not None:
                self.parts.append(("div", content))

    def handle_data(self, data):
        if self.open and self.open[-1][0] in UNSEEN:
            return
        self.texts.append(data)
        inside = None
        for tag, texts in reversed(self.open):
            if texts is not None and not (tag in ("td", "th") and inside == "table"):
                texts.append(data)
            if tag == "table":
                inside = "table"

    def walked(self, page: str) -> _Walk:
        self.feed(page)
        self.close()
        self._close(0)
        return self


PAGES_AT_ONCE = 128  # of one Arrow batch, and pages whose parts are held before they are handed on


def page_parts(pages: DataFrame, kinds: Collection[str] = ("row", "text", "table", "div")) -> DataFrame:
    """Rows of kind ``row`` (cells of a table row), ``text`` (a text node), ``table`` and ``div`` (their text); only of ``kinds``."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_AT_ONCE))
    environment = pages.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if SOURCE not in known:  # lets workers of this machine import the package; elsewhere it is installed
        environment["PYTHONPATH"] = os.pathsep.join([SOURCE, *filter(None, known)])
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for whole in batches:
            for batch in (whole.slice(at, PAGES_AT_ONCE) for at in range(0, len(whole), PAGES_AT_ONCE)):
                out = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    walk = _Walk().walked(html or "")
                    if "row" in kinds:
                        out += [(page_id, url, "row", no, row, cells, None) for no, row, cells in walk.rows]
                    if "text" in kinds:
                        out += [(page_id, url, "text", None, None, None, t.strip()) for t in walk.texts]
                    out += [(page_id, url, kind, None, None, None, t) for kind, t in walk.parts if kind in kinds]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), types)], names)

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, SCHEMA)
