"""ZIP archives as a Spark data source: ``rows.write.format("archives").mode("append").save(folder)``, ``spark.read.format("archives").load(path)``.

Writing takes (name, content); a task fills archives up to the limits of entries and bytes, and a commit names them (see parts). Reading takes one archive, or a folder of them
(those of its commits; without any, all its .zip files). The driver reads central directories only and cuts them into runs of entries of some 32 MB; a task opens its
archive, reads the ranges of its own entries and checks their CRC. Rows: (archive, entry, name, size, content, error). Call register() once per session.

Cases: an entry with a name that leaves the archive, one larger than ``maxEntryBytes``, an encrypted or a damaged one has its ``error`` and a null content; it is never unpacked beyond
the size its directory states. Folders are no entries. Repeated names stay. An archive with more entries than ``maxEntries`` (10,000 unless set) or one that
isn't a ZIP raises an error. With option ``content`` set to false nothing but directories is read. Null contents are written as empty ones; null names raise errors.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from hearthspark.sources.exports import MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES
from hearthspark.sources.parts import PartWriter, commits, store_of

SCHEMA = "archive string, entry int, name string, size bigint, content binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("entry", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_RUN_BYTES = 32 << 20


def name_error(name: str) -> str | None:
    """What is wrong with an entry's name."""
    if name.startswith("/"):
        return "absolute path"
    if "\\" in name:
        return "backslash"
    return "parent folder" if ".." in name else None


class _Writer(PartWriter):
    def __init__(self, path: str, max_entries: int, max_bytes: int) -> None:
        super().__init__(path, ["name", "content"], ".zip")
        self.max_entries, self.max_bytes = max_entries, max_bytes

    def parts(self, batches: Iterator[pa.RecordBatch], new) -> Iterator[int]:
        rows = ((name.as_py(), content.as_py() or b"") for b in batches for name, content in zip(b.column(0), b.column(1)))
        row = next(rows, None)
        while row is not None:
            n = size = 0
            with new() as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                while row is not None and n < self.max_entries and (n == 0 or size + len(row[1]) <= self.max_bytes):
                    name, content = row
                    if not name or name_error(name):
                        raise ValueError(f"{name!r} is no name of an entry")
                    if len(content) > MAX_ENTRY_BYTES:
                        raise ValueError(f"{name} is larger than an entry may be")
                    # A fixed time: equal rows give equal bytes.
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
                    n, size, row = n + 1, size + len(content), next(rows, None)
            yield n


@dataclass
class Run(InputPartition):
    """Entries ``first`` to before ``last`` of an archive's directory."""

    archive: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, max_entries: int, max_bytes: int, content: bool) -> None:
        self.path, self.max_entries, self.max_bytes, self.content = path, max_entries, max_bytes, content

    def _archives(self) -> list[str]:
        store, base = store_of(self.path)
        kind = store.get_file_info(base).type
        if kind == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no archive at {self.path}")
        if kind == pafs.FileType.File:
            return [base]
        found = commits(self.path)
        if found:
            return [f"{base}/{name}" for x in found for name, _ in x["files"]]
        return sorted(i.path for i in store.get_file_info(pafs.FileSelector(base)) if i.path.endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        store, _ = store_of(self.path)
        out: list[InputPartition] = []
        for archive in self._archives():
            with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                entries = z.infolist()
            if len(entries) > self.max_entries:
                raise ValueError(f"{archive} has {len(entries)} entries, more than {self.max_entries}")
            first = held = 0
            for i, e in enumerate(entries):
                if held and held + e.file_size > _RUN_BYTES:
                    out.append(Run(archive, first, i))
                    first, held = i, 0
                held += e.file_size
            if entries:
                out.append(Run(archive, first, len(entries)))
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for i, e in enumerate(z.infolist()[partition.first : partition.last], partition.first):
                if not e.is_dir():
                    content, error = self._content(z, e)
                    yield pa.RecordBatch.from_pylist([{"archive": partition.archive, "entry": i, "name": e.filename, "size": e.file_size, "content": content, "error": error}], schema=_ARROW)

    def _content(self, z: zipfile.ZipFile, e: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        error = name_error(e.orig_filename) or ("entry too large" if e.file_size > self.max_bytes else "encrypted" if e.flag_bits & 1 else None)
        if error or not self.content:
            return None, error
        try:
            with z.open(e) as f:
                content = f.read(e.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as found:
            return None, f"damaged: {found}"
        return (content, None) if len(content) == e.file_size else (None, "damaged: size differs")


class Archives(DataSource):
    """The data source ``archives``."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def _number(self, option: str, default: int) -> int:
        return int(self.options.get(option, default))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("archives are appended; write to a new folder")
        if [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("name", "string"), ("content", "binary")]:
            raise ValueError("an archive takes (name string, content binary)")
        return _Writer(self.options["path"], self._number("maxEntries", MAX_ENTRIES), self._number("maxBytes", MAX_TOTAL_BYTES))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self._number("maxEntries", MAX_ENTRIES), self._number("maxEntryBytes", MAX_ENTRY_BYTES), self.options.get("content", "true") != "false")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Archives)
