"""SHA-256 of files of any length, with bounded reading and memory in each task.

A digest is one chain over a file's bytes, so a file of more than ``HOP`` bytes is a relay: a task hashes at most that many bytes in small blocks and hands the chain's state on, and the next job's task goes
on from there. Files take part side by side, one to a task; smaller files are read in one job, packed as Spark packs files. hashlib's objects can't be stored, so states are those of the library
that it stands on (OpenSSL's SHA256_CTX); a worker without it hashes the whole file in one task, still block by block.

Cases: a file that has become shorter than it was listed raises an error; of one that has grown the listed length counts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.sources.cuts import cut

#: Most bytes of a file that one task reads, bytes that are held at a time, bytes of a file's beginning that are kept, and bytes of a state.
HOP, BLOCK, HEAD, STATE = 256 << 20, 4 << 20, 16, 112
_RELAY = "path string, size bigint, at bigint, state binary, head binary, sha256 string"


def file_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark's file scans give it (not encoded), and the path in it; an error for schemes that pyarrow doesn't know."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/"))


@cache
def _library() -> ctypes.CDLL | None:
    """OpenSSL as hashlib loads it, if states can be taken from it and put back."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
        found.SHA256_Init.argtypes = [ctypes.c_void_p]
        chain = Chain(found)
        chain.update(b"x" * 100)
        chain = Chain(found, chain.state())
        chain.update(b"y" * 100)
        return found if chain.hexdigest() == hashlib.sha256(b"x" * 100 + b"y" * 100).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


class Chain:
    """A SHA-256 whose state can be stored."""

    def __init__(self, library: ctypes.CDLL, state: bytes | None = None) -> None:
        self.library, self.context = library, ctypes.create_string_buffer(state or b"", 2 * STATE)
        if state is None:
            library.SHA256_Init(self.context)

    def update(self, block: bytes) -> None:
        self.library.SHA256_Update(self.context, block, len(block))

    def state(self) -> bytes:
        return self.context.raw[:STATE]

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, self.context)
        return out.raw.hex()


def hashed(path: str, size: int, at: int, state: bytes | None, head: bytes | None, hop: int) -> tuple[int, bytes | None, bytes | None, str | None]:
    """``hop`` bytes further in a file: where that is, the state there, the file's head and, at its end, the digest."""
    library = _library()
    if library is None:
        at, state, hop = 0, None, size
    chain, end = Chain(library, state) if library else hashlib.sha256(), min(at + hop, size)
    store, name = file_of(path)
    with store.open_input_file(name) as f:
        if head is None:
            head = f.read(min(HEAD, size))
        f.seek(at)
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                raise OSError(f"{path} has become shorter than {size} bytes")
            chain.update(block)
            at += len(block)
    return (at, None, head, chain.hexdigest()) if at == size else (at, chain.state(), head, None)


def _relay(hop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["sha256"] is None:
                    row["at"], row["state"], row["head"], row["sha256"] = hashed(row["path"], row["size"], row["at"], row["state"], row["head"], hop)
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return run


def with_digests(files: DataFrame, hop: int = HOP) -> DataFrame:
    """(path, size, sha256, head) of ``files`` (path, size), as a scan of files lists them. As many jobs as the longest file has hops run before it returns."""
    facts = files.agg(F.count_if(F.col("size") > hop).alias("n"), F.max("size").alias("longest")).first()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = files.select("path", "size", F.lit(0).cast("bigint").alias("at"), none("binary", "state"), none("binary", "head"), none("string", "sha256"))
    step = lambda df: df.mapInArrow(_relay(hop), _RELAY)
    out = step(rows.filter(F.col("size") <= hop))
    if facts["n"]:
        # By ranges, as each of the long files gets a task of its own so.
        long = cut(rows.filter(F.col("size") > hop).repartitionByRange(facts["n"], "path"))
        for _ in range(-(-facts["longest"] // hop) - 1):
            long = cut(step(long))
        out = out.unionByName(step(long))
    return out.select("path", "size", "sha256", "head")
