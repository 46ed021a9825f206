"""Sinks, snapshots and archives. Rows are written by tasks; the driver touches manifests and single-file exports of streamed rows only."""

from __future__ import annotations

import json
import zipfile
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators.quality import errors, rule
from hearthspark.schemas import EXPORT_COLUMNS, GENDER, RESIDENT_STATUS
from hearthspark.sources import digests, workbooks

# Limits of an archive.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 10_000, 262_144_000, 2_147_483_648


def export_rows(view: DataFrame, as_of: date) -> DataFrame:
    """The thirteen export columns of a resident view, as text, ``-`` for what is missing."""
    dash = lambda x: F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("-"))
    values = {
        "gender": E.label(F.col("gender"), GENDER), "birth_date": F.date_format("birth_date", "dd-MM-yyyy"), "age": E.age_years(F.col("birth_date"), as_of), "rt": F.col("rt_number"),
        "area_unit": E.area_label(F.col("area_type"), F.col("area_code"), F.col("area_name")), "resident_status": E.label(F.col("resident_status"), RESIDENT_STATUS),
    }
    there = lambda k: F.col(k) if k in view.columns else F.lit(None)  # noqa: E731  lookups that were not joined
    return view.select(*[dash(values[k] if k in values else there(k)).alias(title) for k, title in EXPORT_COLUMNS.items()])


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` gives one part file, by one task."""
    (rows.coalesce(1) if single else rows).write.mode("errorifexists").option("header", True).csv(path)


def write_xlsx(rows: DataFrame, path: str) -> int:
    """One workbook on the driver's disk, rows streamed a partition at a time; more rows than a sheet holds are refused. Returns the number of rows. The data source ``workbooks`` writes from tasks."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in workbooks.PARTS.items():
            z.writestr(name, text)
        with z.open(workbooks.SHEET, "w", force_zip64=True) as f:
            f.write(workbooks.opening(rows.columns))
            for row in rows.toLocalIterator(prefetchPartitions=True):
                n += 1
                if n >= workbooks.SHEET_ROWS:
                    raise ValueError("more rows than a sheet holds; export CSV")
                f.write(workbooks.line("" if v is None else str(v) for v in row))
            f.write(workbooks.CLOSING)
    return n


def read_xlsx(path: str) -> list[list[str]]:
    """Rows of a workbook that write_xlsx() made."""
    with zipfile.ZipFile(path) as z, z.open(workbooks.SHEET) as sheet:
        return list(workbooks.sheet_rows(sheet))


def file_inventory(spark: SparkSession, path: str, hop: int = digests.HOP) -> DataFrame:
    """(path, size, sha256, mime_type) of every file under a folder but empty ones. A task reads at most ``hop`` bytes of a file, in blocks. Where only Spark's readers
    know the path's scheme, a file is one value, so it must fit a task's memory (2 GB at most)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = files.select("path").first()
    try:
        if first:
            digests.file_of(first["path"])
    except (OSError, ValueError, NotImplementedError):
        return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), E.mime_type(F.col("content")).alias("mime_type"))
    return digests.with_digests(files.select("path", F.col("length").alias("size")), hop).select("path", "size", "sha256", E.mime_type(F.col("head")).alias("mime_type"))


def upload_errors(name: Column, mime: Column, size: Column) -> Column:
    """Of an uploaded picture: kind and size."""
    return errors(
        rule(~F.lower(name).rlike(r"\.(jpg|jpeg|png)$"), "file", "Berkas harus JPG, JPEG atau PNG."),
        rule(~F.coalesce(mime, F.lit("")).isin("image/jpeg", "image/png"), "file", "Isi berkas bukan gambar yang didukung."),
        rule(size > 5120 * 1024, "file", "Ukuran berkas melebihi 5 MB."),
    )


def archive_errors(name: Column, size: Column, max_bytes: int = MAX_ENTRY_BYTES) -> Column:
    """Of an archive entry: paths that leave the archive, and its size."""
    return errors(
        rule(name.startswith("/"), "name", "absolute path"),
        rule(F.instr(name, "\\") > 0, "name", "backslash"),
        rule(F.instr(name, "..") > 0, "name", "parent folder"),
        rule(size > max_bytes, "size", "entry too large"),
    )


def archive_summary(entries: DataFrame, required: list[str], name: str = "name", size: str = "size") -> DataFrame:
    """One row: ``ok`` and the figures of an archive's entries (name, size)."""
    bad = F.count_if(F.size(archive_errors(F.col(name), F.col(size))) > 0)
    have = F.count_distinct(F.when(F.col(name).isin(required), F.col(name)))
    out = entries.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), bad.alias("bad"), have.alias("have"))
    ok = (F.col("file_count") <= MAX_ENTRIES) & (F.col("total_size") <= MAX_TOTAL_BYTES) & (F.col("bad") == 0) & (F.col("have") == len(required))
    return out.select("file_count", "total_size", ok.alias("ok"))


def snapshot_manifest(tables: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(tbl, n, lo, hi, sk) of each table (rows, key, measure): row count, key range and sum of the measure."""
    parts = [rows.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(measure).cast("long").alias("sk")) for name, (rows, key, measure) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checksum(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (n, checksum), or one for each value of ``by``, whatever the order of rows: the sum of their hashes, so that pairs don't cancel out."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(set(rows.columns) - set(by or []))]).cast("decimal(38,0)")
    return rows.groupBy(*by or []).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def write_snapshot(tables: dict[str, DataFrame], root: str) -> dict:
    """Every table as Parquet under ``root`` and a manifest beside them; the manifest is written last, so a folder without one is no snapshot."""
    manifest = {}
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{name}.parquet")
        manifest[name] = checksum(rows.sparkSession.read.parquet(f"{root}/{name}.parquet")).first().asDict()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{root}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each checked against the manifest."""
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    out = {}
    for name, want in manifest.items():
        out[name] = spark.read.parquet(f"{root}/{name}.parquet")
        if checksum(out[name]).first().asDict() != want:
            raise ValueError(f"{name} differs from its manifest")
    return out
