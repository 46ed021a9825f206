"""Operator 4, WARC archives with a two-level capture index.

Rows are dealt by range of their reversed-host (SURT) URL key. Each task writes one archive, a gzip member per record, and beside it one
index file: capture lines in key order, cut into blocks of ``block_lines`` lines, a gzip member per block. The rows it returns, one per
block (first and last key, file, offset, length), are the sparse block directory, kept as a Parquet table in key order. Lookups
take two steps: tasks with sorted keys load their stretch of the directory and binary-search it for the blocks of each key; then each block is range-read once,
by whichever task it falls to, its lines are binary-searched for the keys that want it, and their records are range-read. A key with very many captures is thus spread over as
many tasks as its blocks. The query reads every page back in this way, by its URL.

Of records with equal payloads of ``min_dedup`` bytes or more, that with the largest id holds the payload; the others are
revisit records that refer to it. The table of digests is counted with map-side combining and met by a join that survives hot
payloads; the decisions travel to the writers as rows of their own, sorted before the page they belong to, so the
payloads are shuffled once.

Each attempt of a task writes files of its own name, and only the directory rows of the attempt that Spark commits name any, so repeated or lost tasks leave
files that nothing refers to and never overwrite. Paths may be of any store that pyarrow's file systems know (file, hdfs, s3, gs).

Cases: a null url or payload is empty; a null id is written as an empty id and read back as null; repeated rows are records of
their own (of rows that share the largest id and payload, all are responses); an empty table gives an empty archive; other columns are
ignored. Header values are percent-encoded where they hold line breaks.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm.common import cut, fresh_dir, spread_lookup

MIN_DEDUP = 1000
BLOCK_LINES = 512
#: Compressed bytes of records that a task should read back.
TASK_BYTES = 32 << 20
#: Fixed, so that equal archives have equal bytes.
DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "first_key string, last_key string, path string, block_offset long, block_length long, n_lines int, record_bytes long"


def surt(url: str) -> str:
    """com,example,www)/path?query of a URL: the host's labels reversed, lower case, without scheme, port 80 or 443, or fragment."""
    rest = url.split("://", 1)[1] if "://" in url else url
    rest = rest.split("#", 1)[0]
    m = re.search(r"[/?]", rest)
    host, path = (rest[: m.start()], rest[m.start() :]) if m else (rest, "/")
    host = re.sub(r":(80|443)$", "", host.rsplit("@", 1)[-1].lower())
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (path if path.startswith("/") else "/" + path)


def _record(row: dict) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    revisit, payload = row["refers_to"] is not None, row["payload"]
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(row["id"])), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(row["url"], safe="".join(chr(c) for c in range(33, 127)))), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()),
        ("X-Payload-Length", str(row["n_bytes"])), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(row["refers_to"]))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member. The payload of a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    number = lambda u: int(n) if (n := u.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "id": number(h["WARC-Record-ID"]), "url": unquote(h["WARC-Target-URI"]), "type": h["WARC-Type"], "payload": payload, "digest": digest,
        "n_bytes": int(h["X-Payload-Length"]), "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
    }


def _writer(root: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in key order; a row without payload says what the next page of its id refers to."""
        store, base = pafs.FileSystem.from_uri(root)
        archive = index = None
        at = lines_at = block_at = 0
        lines: list[str] = []
        directory: list[tuple] = []
        refers: dict[str, int] = {}
        page = None
        final = ""

        def end_block() -> None:
            nonlocal lines, lines_at, block_at
            if lines:
                block = gzip.compress("".join(x + "\n" for x in lines).encode(), 6, mtime=0)
                index.write(block)
                directory.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], final + ".cdx.gz", lines_at, len(block), len(lines), at - block_at))
                lines, lines_at, block_at = [], lines_at + len(block), at

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    from pyspark import TaskContext

                    final = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    archive, index = store.open_output_stream(final + ".warc.gz", compression=None), store.open_output_stream(final + ".cdx.gz", compression=None)
                if page != (row["key"], row["id"]):
                    page, refers = (row["key"], row["id"]), {}
                if row["tag"] == 0:
                    refers[row["digest"]] = row["refers_to"]
                    continue
                row["payload"] = (row["html"] or "").encode("utf-8", "surrogatepass")
                row["n_bytes"], row["digest"] = len(row["payload"]), hashlib.sha1(row["payload"]).hexdigest()
                row["refers_to"] = refers.get(row["digest"])
                member = _record(row)
                archive.write(member)
                lines.append(f"{row['key']}\t" + json.dumps({"id": row["id"], "offset": at, "length": len(member)}, separators=(",", ":")))
                at += len(member)
                if len(lines) == block_lines:
                    end_block()
        if archive is not None:
            end_block()
            archive.close()
            index.close()
        columns = list(zip(*directory, strict=True)) if directory else [[]] * 7
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in DIRECTORY.split(", ")])

    return write


def key_column(url):
    """surt() of a column, in Spark's own functions, with line breaks and tabs encoded."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^[^/?]*", 0)), r"(?s)^.*@", ""), r":(80|443)$", "")
    name, port = F.substring_index(host, ":", 1), F.regexp_extract(host, r"(?s):.*$", 0)
    path = F.regexp_extract(rest, r"(?s)[/?].*$", 0)
    path = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), path)
    return F.replace(F.replace(F.replace(key, F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup: int = MIN_DEDUP, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the archives and their index under ``root``, the directory as ``root``/directory; returns the directory."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    facts = cut(rows.filter(F.octet_length("html") >= min_dedup).select("id", key_column(F.col("url")).alias("key"), F.sha1(F.encode("html", "UTF-8")).alias("digest")).withColumn("spread", F.monotonically_increasing_id()))
    same = cut(facts.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    told = spread_lookup(facts, same, "digest", "n", "spread", ["keeper"]).filter("keeper is not null and not (id <=> keeper)")
    told = told.select("id", "key", F.lit("").alias("url"), F.lit("").alias("html"), "digest", F.col("keeper").alias("refers_to"), F.lit(0).alias("tag")).dropDuplicates(["id", "key", "digest"])
    sent = rows.select("id", key_column(F.col("url")).alias("key"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("tag"))
    _make_dir(spark, root)
    dealt = told.unionByName(sent).repartitionByRange("key", "id").sortWithinPartitions("key", "id", "tag")
    found = dealt.mapInArrow(_writer(root, block_lines), DIRECTORY)
    found.write.mode("errorifexists").parquet(f"{root}/directory")
    return spark.read.parquet(f"{root}/directory")


def _make_dir(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _read_range(store: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def blocks_of(directory: list[tuple], key: str) -> list[tuple]:
    """The blocks of ``directory`` (first_key, last_key, ...; in key order) that may hold a key: a binary search, then on while blocks begin with it or before."""
    i = j = bisect.bisect_left(directory, key, key=lambda d: d[1])
    while j < len(directory) and directory[j][0] <= key:
        j += 1
    return directory[i:j]


def captures(store: pafs.FileSystem, path: str, offset: int, length: int, keys: list[str]) -> Iterator[dict]:
    """The records of ``keys`` in one block: one range read of the block, a binary search of its lines for each key, one range read for each record."""
    lines = zlib.decompress(_read_range(store, path, offset, length), 31).decode().split("\n")[:-1]
    with store.open_input_file(path.replace(".cdx.gz", ".warc.gz")) as f:
        for key in keys:
            for i in range(bisect.bisect_left(lines, key, key=lambda x: x.split("\t", 1)[0]), len(lines)):
                found, at = lines[i].split("\t", 1)
                if found != key:
                    break
                at = json.loads(at)
                yield parse_record(f.read_at(at["length"], at["offset"])) | {"key": key}


BLOCK = "key string, path string, block_offset long, block_length long"
CAPTURE = "key string, id long, url string, type string, n_bytes long, digest string, refers_to long"


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in (x.split() for x in schema.split(", "))], names=[x.split()[0] for x in schema.split(", ")])


def lookup_urls(urls: DataFrame, root: str, url_col: str = "url", task_bytes: int = TASK_BYTES) -> DataFrame:
    """All captures of the distinct URLs in ``urls``, each once. Payloads are checked against their digests and let go, one at a time."""
    spark = urls.sparkSession
    keys = urls.select(key_column(F.col(url_col)).alias("key")).distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if wanted:
                part = pq.read_table(f"{base}/directory", filesystem=store, filters=[("last_key", ">=", wanted[0]), ("first_key", "<=", wanted[-1])])
                rows = sorted(tuple(r[c] for c in ("first_key", "last_key", "path", "block_offset", "block_length")) for r in part.to_pylist())
                yield _batch([{"key": key, "path": d[2], "block_offset": d[3], "block_length": d[4]} for key in wanted for d in blocks_of(rows, key)], BLOCK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        last, keys, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                block = (row["path"], row["block_offset"], row["block_length"])
                if block != last and keys:
                    out += ({n: v for n, v in hit.items() if n != "payload"} for hit in captures(store, *last, keys))
                    keys = []
                    if len(out) >= 4096:
                        yield _batch(out, CAPTURE)
                        out = []
                last = block
                keys.append(row["key"])
        if keys:
            out += ({n: v for n, v in hit.items() if n != "payload"} for hit in captures(store, *last, keys))
        yield _batch(out, CAPTURE)

    facts = spark.read.parquet(f"{root}/directory").agg(F.coalesce(F.sum("record_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, -(-facts["bytes"] // task_bytes), min(facts["n"], spark.sparkContext.defaultParallelism))
    blocks = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, BLOCK)
    # The number is stated: by the few bytes of these rows, AQE would put all blocks into one task.
    return blocks.repartition(tasks, "path", "block_offset").sortWithinPartitions("path", "block_offset", "key").mapInArrow(read, CAPTURE)


def digest(captures: DataFrame) -> DataFrame:
    """The contract's columns."""
    return captures.select(F.col("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new place in the shared folder and looks the records of all its URLs up again."""
    root = fresh_dir(pages.sparkSession, "warc")
    write_archives(pages, root)
    return lookup_urls(pages.select(F.col("url")), root)
