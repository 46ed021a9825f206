"""A corpus pipeline over documents: toxicity, near-duplicates, benchmark contamination, secrets, SentencePiece samples.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs. All but
the last return the columns of documents. Rows are told apart by their file and place in it, so null and repeated ids do no harm; null texts are empty
texts and stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm import decontaminate, jaccard, sampling, secrets, simhash, toxicity
from hearthspark.llm.common import cut, fresh_dir, numbered, remove, without, written
from hearthspark.sources.tables import table

_ROW = "_pipeline_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near fingerprints (of ids that repeat, the first row; null ids come last)."""
    rows = numbered(docs, _ROW)
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(_ROW)).alias("id"), "text")
    found = simhash.near_duplicates(keyed, "id", "text")
    gone = cut(found.filter(~F.col("id").eqNullSafe(F.col("component"))).select(F.col(f"id.{_ROW}").alias(_ROW)))
    return without(rows, gone, _ROW).drop(_ROW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What drop_near_duplicates() keeps, without near copies by the general rule: five-word shingles, Jaccard similarity 0.8 or more."""
    kept = drop_near_duplicates(spark, docs, sf_dir)
    # Numbers in the order of the ids, so that the smallest id of a group stays; null ids come last, rows of one id in the order of a hash.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"))
    rows = written(kept.orderBy(order).withColumn(_ROW, F.monotonically_increasing_id()), "ordered")
    return without(rows, cut(jaccard.near_copies(rows.select(F.col(_ROW).alias("rid"), "text")).withColumnRenamed("rid", _ROW)), _ROW).drop(_ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words inside benchmark passages."""
    rows = numbered(docs, _ROW)
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col=_ROW)
    return without(rows, cut(found.filter(decontaminate.contaminated()).select(F.col("id").alias(_ROW))), _ROW).drop(_ROW)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask and n_chars counted anew where that happened."""
    rows = numbered(docs, _ROW)
    found = secrets.scan_secrets(rows, id_col=_ROW, repo_col="doc_id", owner_col="source")
    hit = found.filter(F.size("spans") > 0).select(F.col("id").alias(_ROW), "spans")
    text = F.when(F.col("spans").isNotNull(), secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = rows.join(hit, _ROW, "left").withColumn("text", text)
    out = out.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, the figures of its sampled segmentations."""
    return sampling.digest(sampling.encode_samples(docs, with_ids=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("sentencepiece sampling", encode),
]

#: Fitting a chain, hashing with a seed and sampling lattices are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_dir(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
