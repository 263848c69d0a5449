"""Formats that need Python: ZIP archives of office documents, and HTML tables. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def control_entries(raw: bytes) -> list[tuple[str, str]]:
    """(alias or tag, text) of every content control in document order; the tag counts only without an alias element."""
    out = []
    for control in ElementTree.fromstring(raw).iter(_W + "sdt"):
        props, body = control.find(_W + "sdtPr"), control.find(_W + "sdtContent")
        label = None
        if props is not None:
            named = props.find(_W + "alias")
            named = props.find(_W + "tag") if named is None else named
            label = named.get(_W + "val") if named is not None else None
        if label and body is not None:
            out.append((label, "".join(t.text or "" for t in body.iter(_W + "t")).strip()))
    return out


def archive_controls(files: DataFrame, skip: str = "Test Form") -> DataFrame:
    """binaryFile rows of ZIP archives -> (path, entry, pos, alias, text, error). Entries are visited in name order; one that cannot be parsed gives a row with the error.

    Only names that end in ".xml" count, in lower case. Rows without a path column have a null path.
    """
    files = files.select(F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in sorted(n for n in z.namelist() if n.endswith(".xml") and skip not in n):
                            try:
                                rows += [(path, entry, i, a, t, None) for i, (a, t) in enumerate(control_entries(z.read(entry)))]
                            except ElementTree.ParseError as e:
                                rows.append((path, entry, None, None, None, str(e)))
                except zipfile.BadZipFile as e:
                    rows.append((path, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["path", "entry", "pos", "alias", "text", "error"])
            out["pos"] = out["pos"].astype("Int32")
            if len(out):  # an empty string column has no Arrow array
                yield out

    return files.mapInPandas(run, "path string, entry string, pos int, alias string, text string, error string")


def pdf_texts(files: DataFrame, name: str = "path") -> DataFrame:
    """binaryFile rows of PDF files -> (name, text, error): page texts one after the other, as the library gives them.

    The PDF library is optional; without it, and for files it cannot read, text is null and error says why.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for batch in batches:
            rows = []
            for key, content in zip(batch[name], batch["content"]):
                try:
                    if PdfReader is None:
                        raise ValueError("no PDF library installed")
                    pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]
                    rows.append((key, "".join(pages), None))
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=[name, "text", "error"])

    return files.select(name, "content").mapInPandas(run, f"`{name}` string, text string, error string")


class _Tables(HTMLParser):
    """Rows of all tables, with the table's classes and the h2 heading that stands directly before it."""

    def __init__(self, strip_nodes: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.strip_nodes = strip_nodes
        self.rows: list[tuple[int, str, str, int, list[str]]] = []
        self.table, self.row, self.depth = -1, -1, 0
        self.cell: list[str] | None = None
        self.title: list[str] | None = None
        self.heading, self.classes, self.before = "", "", ""

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.depth = self.table + 1, -1, self.depth + 1
            self.classes, self.before, self.heading = dict(attrs).get("class") or "", self.heading, ""
        elif tag == "h2":
            self.title = []
        elif tag == "tr" and self.depth:
            self.row += 1
            self.rows.append((self.table, self.classes, self.before, self.row, []))
        elif tag in ("td", "th") and self.rows and self.depth:
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag == "h2" and self.title is not None:
            self.heading, self.title = re.sub(r"\s+", " ", "".join(self.title)).strip(), None
        elif tag in ("td", "th") and self.cell is not None:
            text = "".join(map(str.strip, self.cell)) if self.strip_nodes else re.sub(r"\s+", " ", "".join(self.cell)).strip()
            self.rows[-1][4].append(text)
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.title is not None:
            self.title.append(data)


def html_rows(df: DataFrame, id_col: str, html_col: str, strip_nodes: bool = False) -> DataFrame:
    """(id, table_no, table_class, heading, row_no, cells) for each row of each HTML table; null pages give no rows.

    heading is the h2 with no other table between it and this one, else ''. Comments are not text.
    strip_nodes: text nodes are trimmed one by one and joined without a blank, else a cell's text is collapsed and trimmed whole.
    """
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "table_no", "table_class", "heading", "row_no", "cells"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, page in zip(batch[id_col], batch[html_col]):
                parser = _Tables(strip_nodes)
                parser.feed(page or "")
                out += [(key, *r) for r in parser.rows]
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {kind}, table_no int, table_class string, heading string, row_no int, cells array<string>")
