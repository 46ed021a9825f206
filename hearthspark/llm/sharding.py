"""Operator 7, sharding by size-tiered compaction. DataFrame readers and writers only.

A table is a folder: ``data/<run>/`` holds a run of immutable Parquet shards, ``manifest/v<version>.json`` lists the runs of a version. Each arrival is
appended as a run of small shards. A run's tier is the logarithm of its size to the base ``fan``; whenever a tier holds ``fan`` runs, they are
merged into one run of target-sized files, which reads them once and shuffles nothing, and so on upward: each byte is rewritten once per tier. A version is committed by renaming a
complete manifest to the next number, which fails if another writer took that number; the loser reads the new version and tries
again (appends always apply; a merge whose inputs are gone is dropped). Readers see whole versions only; ``vacuum`` removes runs
that no kept version names.

The driver handles names and sizes of files; rows stay in tasks, each of which writes about one target-sized file.

Cases: an empty arrival commits a version without a new run; a table without runs reads as the given schema without rows; rows are kept as they are:
nulls, repeats, any columns. Column names that differ in case only are refused by Spark's readers and so here.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthspark.llm.common import fresh_dir

TARGET_BYTES = 64 << 20
FAN = 4
#: Runs below this size are of tier 0.
BASE_BYTES = 1 << 20
ARRIVALS = 8
_TRIES = 20


@dataclass(frozen=True)
class Run:
    name: str
    files: int
    bytes: int
    rows: int

    def tier(self, fan: int, base: int) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / base, fan)) + 1) if self.bytes >= base else 0


class ShardedTable:
    """A folder of runs and manifests; ``schema`` is that of all arrivals."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan: int = FAN, base_bytes: int = BASE_BYTES) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fan, self.base_bytes = target_bytes, fan, base_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(self._path("manifest")) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> tuple[int, list[Run]]:
        """The latest or a given version's number and runs; version 0 is empty."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return 0, []
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(**r) for r in json.loads(text)["runs"]]

    def _commit(self, version: int, runs: list[Run]) -> bool:
        """False if another writer has committed ``version`` already. The check is atomic on HDFS; local disks and object stores look before they rename, so there one committer at a time is assumed."""
        part = self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.getFileSystem(self._conf).getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path(f"manifest/v{version:08d}.json")), none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _write(self, df: DataFrame) -> Run:
        """Writes a run; its files count only once a manifest names it."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{name}")
        files = [s for s in self._fs.listStatus(self._path(f"data/{name}")) if s.getPath().getName().endswith(".parquet")]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{name}").count()  # from the files' footers
        return Run(name, len(files), sum(s.getLen() for s in files), rows)

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival as a run of shards, one per partition; returns the version."""
        run = self._write(arrival)
        for _ in range(_TRIES):
            version, runs = self.runs()
            if self._commit(version + 1, [*runs, run] if run.rows else runs):
                return version + 1
        raise RuntimeError("too many writers")

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that holds ``fan`` of them."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(r.tier(self.fan, self.base_bytes), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def merge(self, runs: list[Run]) -> bool:
        """Merges ``runs`` into one of target-sized files; False if one of them is gone from the latest version."""
        n = max(1, math.ceil(sum(r.bytes for r in runs) / self.target_bytes))
        merged = self._write(self._read(runs).coalesce(n))
        if merged.rows != sum(r.rows for r in runs):
            raise RuntimeError(f"a merge of {sum(r.rows for r in runs)} rows wrote {merged.rows}")
        names = {r.name for r in runs}
        for _ in range(_TRIES):
            version, now = self.runs()
            if not names <= {r.name for r in now}:
                return False
            if self._commit(version + 1, [*(r for r in now if r.name not in names), merged]):
                return True
        raise RuntimeError("too many writers")

    def compact(self) -> int:
        """Merges until no tier is full; returns the number of merges."""
        n = 0
        while due := self.due(self.runs()[1]):
            n += self.merge(due)
        return n

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{r.name}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the latest or a given version."""
        return self._read(self.runs(version)[1])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last ``keep`` and runs that these don't name; not to be run beside writers. Returns the number of runs deleted."""
        versions = self.versions()
        kept = {r.name for v in versions[-keep:] for r in self.runs(v)[1]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in kept] if self._fs.exists(self._path("data")) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def arrivals(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """``n`` stretches of ``df`` by ranges of a whole-number key, which scans prune by; null keys come first."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return [df]
    cuts = [ends["lo"] + (ends["hi"] - ends["lo"] + 1) * i // n for i in range(1, n)]
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = F.lit(True) if lo is None else F.col(key) >= lo
        part = part & (F.col(key) < hi) if hi is not None else part
        out.append(df.filter(part | F.col(key).isNull() if lo is None else part))
    return out


def shard(docs: DataFrame, key: str = "doc_id", n_arrivals: int = ARRIVALS, **params: int) -> DataFrame:
    """``docs`` through a new table: appended in ``n_arrivals`` arrivals, compacted after each, vacuumed, read back whole."""
    store = ShardedTable(docs.sparkSession, fresh_dir(docs.sparkSession, "shards"), docs.schema, **params)
    for part in arrivals(docs, key, n_arrivals):
        store.append(part)
        store.compact()
    store.vacuum()
    return store.read()


def digest(rows: DataFrame) -> DataFrame:
    """One row per document read back: its columns, the text as SHA-256."""
    return rows.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))
