"""Spreadsheets (.xlsx) as rows of text keyed by header, as a Python data source named ``workbook``, one partition a file."""

from __future__ import annotations

import glob
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_name string, sheet_name string, row_number int, cells map<string,string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    letters = re.match(r"[A-Z]+", reference)
    if not letters:
        raise ValueError(f"no column in {reference!r}")
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - ord("A") + 1
    return n - 1


def _inside(target: str) -> str:
    """Where a workbook part lies in its archive."""
    return target[1:] if target.startswith("/") else target if target.startswith("xl/") else posixpath.join("xl", target)


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def rows_of(data: bytes, name: str) -> Iterator[tuple[str, str, int, dict[str, str]]]:
    """(file, sheet, row number, header to cell) of the first sheet that isn't a summary; empty rows are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {r.get("Id"): _inside(r.get("Target")) for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        sheet, part = next(((n, p) for n, p in sheets if n.lower() != "summary"), sheets[0])
        header: dict[int, str] = {}
        with book.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {}
                for c in row.iter(f"{_MAIN}c"):
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    text = _text(c) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
                    cells[column_number(c.get("r"))] = text
                number = int(row.get("r") or 0)
                row.clear()
                if not header:
                    header = {k: t.strip() for k, t in cells.items() if t.strip()}
                elif any(cells.values()):
                    yield name, sheet, number, {header[k]: t for k, t in cells.items() if k in header}


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all workbooks at ``path`` (anything Spark's readers open); one file is one task's work."""
    files = spark.read.format("binaryFile").load(path)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = list(rows_of(bytes(content), name.rsplit("/", 1)[-1]))
                yield pd.DataFrame(rows, columns=["file_name", "sheet_name", "row_number", "cells"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def with_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Workbook rows with named cells as columns; an unknown header gives nulls."""
    return rows.select("file_name", "sheet_name", "row_number", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("workbook").load(folder)`` available for local files."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            found = sorted(glob.glob(f"{self.path}/*.xlsx")) or [self.path]
            return [InputPartition(p) for p in found]

        def read(self, partition):
            with open(partition.value, "rb") as f:
                yield from rows_of(f.read(), partition.value.rsplit("/", 1)[-1])

    class Workbook(DataSource):
        @classmethod
        def name(cls):
            return "workbook"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Workbook)
