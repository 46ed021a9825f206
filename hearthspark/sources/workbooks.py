"""XLSX as a Spark data source: ``rows.write.format("workbooks").mode("append").save(path)``, ``spark.read.format("workbooks").load(path)``.

Each task writes workbooks of at most ``sheetRows`` rows (1,000,000 unless set) under a header row, a row at a time; a commit names them (see parts). Reading takes a task per
workbook and holds a block of rows. Columns are text: cast others before. Call register() once per session.

Cases: a null is a cell without a value, an empty text one with an empty value; characters that XML lacks are written as _xHHHH_, as spreadsheets do; a text of more
characters than a cell holds, a column that isn't text and writing with overwrite raise errors; a table of no rows is read back as no rows of its columns.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from hearthspark.sources.parts import PartWriter, commits, store_of

# Limits of a spreadsheet, and the parts of a workbook with one sheet.
CELL_CHARS, SHEET_ROWS = 32_767, 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SHEET = "xl/worksheets/sheet1.xml"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/{SHEET}" ContentType="{_KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_BLOCK = 10_000
CLOSING = b"</sheetData></worksheet>"


def cell(value: str | None) -> str:
    """A cell's XML."""
    if value is None:
        return "<c/>"
    if len(value) > CELL_CHARS:
        raise ValueError(f"a text of {len(value)} characters is more than a cell holds")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))}</t></is></c>'


def line(values: Iterable[str | None]) -> bytes:
    """A row's XML."""
    return f"<row>{''.join(map(cell, values))}</row>".encode()


def opening(columns: list[str]) -> bytes:
    """A sheet up to its header row."""
    return f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + line(columns)


def _value(node: ET.Element) -> str | None:
    if node.find(f"{{{_MAIN}}}is") is None:
        return None
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t")))


class _Writer(PartWriter):
    def __init__(self, path: str, columns: list[str], sheet_rows: int) -> None:
        super().__init__(path, columns, ".xlsx")
        self.sheet_rows = sheet_rows

    def parts(self, batches: Iterator[pa.RecordBatch], new) -> Iterator[int]:
        rows = (row for b in batches for row in zip(*[column.to_pylist() for column in b.columns]))
        row = next(rows, None)
        while row is not None:
            n = 0
            with new() as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in PARTS.items():
                    z.writestr(name, text)
                with z.open(SHEET, "w", force_zip64=True) as f:
                    f.write(opening(self.columns))
                    while row is not None and n < self.sheet_rows:
                        f.write(line(row))
                        n, row = n + 1, next(rows, None)
                    f.write(CLOSING)
            yield n


def sheet_rows(stream) -> Iterator[list[str | None]]:
    """The rows of a sheet, header first; a row is forgotten when the next is asked for."""
    data = None
    for event, node in ET.iterparse(stream, events=("start", "end")):
        if event == "start" and node.tag == f"{{{_MAIN}}}sheetData":
            data = node
        elif event == "end" and node.tag == f"{{{_MAIN}}}row":
            yield [_value(x) for x in node.iter(f"{{{_MAIN}}}c")]
            data.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for found in commits(self.path) for name, _ in found["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        store, base = store_of(self.path)
        with store.open_input_file(f"{base}/{partition.value}") as f, zipfile.ZipFile(f) as z, z.open(SHEET) as sheet:
            rows = sheet_rows(sheet)
            header = next(rows)
            at = [header.index(name) for name in self.columns]
            block: list[list[str | None]] = []
            for row in rows:
                block.append([row[i] for i in at])
                if len(block) == _BLOCK:
                    yield self._batch(block)
                    block = []
            if block:
                yield self._batch(block)

    def _batch(self, block: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(values), pa.string()) for values in zip(*block)], names=self.columns)


class Workbooks(DataSource):
    """The data source ``workbooks``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> StructType:
        found = commits(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no workbooks at {self.options['path']}")
        if len({tuple(x["columns"]) for x in found}) > 1:
            raise ValueError("workbooks of one folder differ in their columns")
        return StructType([StructField(name, StringType()) for name in found[0]["columns"]])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("workbooks are appended; write to a new folder")
        other = [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]
        if other:
            raise ValueError(f"columns of a workbook are text, cast {', '.join(other)}")
        rows = int(self.options.get("sheetRows", 1_000_000))
        if not 0 < rows < SHEET_ROWS:
            raise ValueError(f"a sheet holds 1 to {SHEET_ROWS - 1} rows under its header")
        return _Writer(self.options["path"], schema.names, rows)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Workbooks)
