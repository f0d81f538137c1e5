"""Workbooks (.xlsx): a sheet as a table, read in a task from the file's bytes, whatever store they lie in.

The sheet's XML is parsed as a stream, row by row. The first row gives the names. A column has
a type if all of its cells agree on one: whole numbers, numbers, truth values, times; else it
is text. Formulas count with the value that was stored with them; errors and blanks are null.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: name spaces, and built-in number formats that show dates or times.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
REFERENCE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROWS = 500


class Book:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels").iter(f"{RELATIONS}Relationship")}
        self.sheets = [(s.get("name"), self._place(targets[s.get(REFERENCE)])) for s in book.iter(f"{MAIN}sheet")]
        about = book.find(f"{MAIN}workbookPr")
        self.epoch = datetime.datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else ElementTree.Element("none")

    def _strings(self) -> list[str]:
        return ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]

    def _dates(self) -> list[bool]:
        """By a cell's style, whether it shows a date or a time."""
        styles = self._xml("xl/styles.xml")
        plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower()
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", plain(f.get("formatCode")))}
        cells = styles.find(f"{MAIN}cellXfs")
        return [int(x.get("numFmtId", 0)) in DATE_FORMATS | own for x in (cells if cells is not None else [])]

    def rows(self, sheet: int | str):
        """(row's number, cells as (text, kind)); kinds: n whole number, f number, b truth value, d time, s text, empty for blanks."""
        place = dict(self.sheets)[sheet] if isinstance(sheet, str) else self.sheets[sheet][1]
        strings, dates = self._strings(), self._dates()
        with self.zip.open(place) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[tuple[str | None, str]] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [(None, "")] * (at - len(cells)) + [self._value(cell, strings, dates)]
                yield number, cells
                row.clear()

    def _value(self, cell, strings, dates) -> tuple[str | None, str]:
        kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), "s"
        if value is None or kind == "e":
            return None, ""
        if kind == "s":
            return strings[int(value)], "s"
        if kind == "b":
            return str(value.strip() == "1").lower(), "b"
        if kind == "d":
            return value.replace("T", " ").rstrip("Z"), "d"
        if kind == "str":
            return value, "s"
        style = int(cell.get("s", 0))
        x = float(value)
        if style < len(dates) and dates[style]:
            return str(self.epoch + datetime.timedelta(microseconds=round(x * 86_400_000) * 1000)), "d"
        return (str(int(x)), "n") if x.is_integer() and abs(x) < 1 << 53 else (repr(x), "f")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _parsed(sheet: int | str, first_only: bool = False):
    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held: list[tuple] = []
                for number, cells in Book(raw).rows(sheet):
                    held.append((number, [t for t, _ in cells], [k for _, k in cells]))
                    if len(held) >= _ROWS or first_only:
                        yield _batch(held)
                        held = []
                    if first_only:
                        break
                yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.list_(pa.string())) for c in columns[1:])], names=["n", "cells", "kinds"])


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a workbook's sheets, in order."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                names = [n for n, _ in Book(raw).sheets]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array(names, pa.string())], names=["n", "name"])

    return [r["name"] for r in _bytes(spark, path).mapInArrow(run, "n long, name string").orderBy("n").collect()]


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


_TYPES = {frozenset("n"): "bigint", frozenset("f"): "double", frozenset("nf"): "double", frozenset("b"): "boolean", frozenset("d"): "timestamp_ntz"}


def read_workbook(spark: SparkSession, path: str, sheet_name: int | str = 0) -> DataFrame:
    """A sheet, by its name or place, as a table."""
    from .files import free_names

    ddl, book = "n long, cells array<string>, kinds array<string>", _bytes(spark, path)
    head = book.mapInArrow(_parsed(sheet_name, True), ddl).collect()  # one row
    if not head:
        return spark.createDataFrame([], "value string").drop("value")
    names = free_names([c if c is not None else f"Unnamed: {i}" for i, c in enumerate(head[0]["cells"])])
    rows = book.mapInArrow(_parsed(sheet_name), ddl).filter(F.col("n") > head[0]["n"])
    kinds = rows.agg(*(F.array_sort(F.collect_set(F.get("kinds", F.lit(i)))).alias(str(i)) for i in range(len(names)))).first()
    types = [_TYPES.get(frozenset(k for k in found if k), "string") for found in kinds]
    return rows.select(*(F.get("cells", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))))
