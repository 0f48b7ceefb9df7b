"""Spreadsheet workbooks (Office Open XML) as a Spark source: a partition for each sheet, rows streamed from its zipped XML."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymill.scratch import filesystem

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "sheet string, row int, cells array<string>"


@dataclass
class Sheet(InputPartition):
    """A sheet's name, and its part of the workbook."""

    name: str
    part: str


def _texts(element: ElementTree.Element) -> str:
    """The text of an element's runs, without what is written above them to be read aloud."""
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t") if t not in {x for p in element.iter(f"{MAIN}rPh") for x in p.iter(f"{MAIN}t")})


def column_of(reference: str) -> int:
    """The number of a column, from 0, of a cell reference such as AB12."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheets_of(book: zipfile.ZipFile) -> list[Sheet]:
    """The sheets in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    at = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [Sheet(s.get("name"), at(targets[s.get(RELATION)])) for s in found]


def rows_of(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, texts of its cells) of a sheet; a formula's cell has its value, an empty one null."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}si":
                    shared.append(_texts(e))
                    e.clear()
    last = 0
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            last = int(e.get("r") or last + 1)
            cells: list[str | None] = []
            for c in e.iter(f"{MAIN}c"):
                at = column_of(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[at] = _texts(c)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            e.clear()
            yield last, cells


class SheetReader(DataSourceReader):
    def __init__(self, path: str, wanted: str | None):
        self.path, self.wanted = path, wanted

    def _book(self) -> zipfile.ZipFile:
        system, path = filesystem(self.path)
        return zipfile.ZipFile(system.open_input_file(path))

    def partitions(self) -> list[Sheet]:
        with self._book() as book:
            found = [s for s in sheets_of(book) if self.wanted in (None, s.name)]
        if self.wanted is not None and not found:
            raise ValueError(f"{self.path} has no sheet {self.wanted}")
        return found

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with self._book() as book:
            for row, cells in rows_of(book, partition.part):
                yield partition.name, row, cells


class SheetSource(DataSource):
    """Format ``sheets``: rows (sheet, row, cells) of the workbook ``path``, of one ``sheet`` if that is given."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet"))


def cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheets")
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A sheet as a table of texts with ``_row``: its first row has the names of the columns. Without a name the first sheet."""
    all_ = cells(spark, path, name)
    first = all_.orderBy("row").limit(1) if name is not None else all_.limit(1)
    head = first.first()
    if head is None:
        raise ValueError(f"{path} has no rows")
    body = all_.where((F.col("sheet") == head.sheet) & (F.col("row") > head.row))
    return body.select(*[F.get("cells", F.lit(i)).alias(c.strip()) for i, c in enumerate(head.cells) if c and c.strip()], F.col("row").alias("_row"))
