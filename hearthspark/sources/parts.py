"""Files written by tasks and named by a commit, for Python data sources.

A task writes whole files under names of its own; the driver's commit writes one small file that lists those of the tasks that counted. Readers look at commits only, so files of
lost, repeated or speculative tasks are never read, and a folder without a commit holds nothing. Each write adds one commit. Paths need a scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """A task's files, as (name, rows)."""

    files: list[tuple[str, int]]


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    store, base = pafs.FileSystem.from_uri(path)
    return store, base.rstrip("/")


def commits(path: str) -> list[dict[str, Any]]:
    """What every commit of a folder says; the driver holds the names of files."""
    store, base = store_of(path)
    found = store.get_file_info(pafs.FileSelector(f"{base}/_commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".json"):
            with store.open_input_file(info.path) as f:
                out.append(json.loads(f.read()))
    return out


class PartWriter(DataSourceArrowWriter):
    """Writes ``path`` in files that parts() makes, and commits them with the columns' names."""

    def __init__(self, path: str, columns: list[str], suffix: str) -> None:
        self.path, self.columns, self.suffix = path, columns, suffix

    def parts(self, batches: Iterator[pa.RecordBatch], new) -> Iterator[int]:
        """Writes files, each to a stream and under a name from ``new()``, and yields the rows of each when it is whole."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        names: list[str] = []
        rows: list[int] = []

        def new():
            names.append(f"part-{uuid.uuid4().hex}{self.suffix}")
            return store.open_output_stream(f"{base}/{names[-1]}", compression=None)

        try:
            rows.extend(self.parts(iterator, new))
        except BaseException:
            _remove(store, base, names)
            raise
        return Written(list(zip(names, rows)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        store.create_dir(f"{base}/_commits", recursive=True)
        name = f"{base}/_commits/{uuid.uuid4().hex}"
        with store.open_output_stream(name, compression=None) as f:
            f.write(json.dumps({"columns": self.columns, "files": files}).encode())
        store.move(name, f"{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = store_of(self.path)
        _remove(store, base, [name for m in messages if m is not None for name, _ in m.files])


def _remove(store: pafs.FileSystem, base: str, names: list[str]) -> None:
    for name in names:
        if store.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
            store.delete_file(f"{base}/{name}")
