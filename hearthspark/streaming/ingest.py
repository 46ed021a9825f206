"""Extension beyond the reference: streaming ingest of raw texts. New files are read as a stream, repeats of a source within the watermark are
dropped by their hash, and each micro-batch is parsed and appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthspark.operators.household_text import parse_households

INCOMING = "id string, raw_text string, confidence double, arrived timestamp"


def text_stream(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """JSON lines of INCOMING as they arrive; a text that repeats within the watermark comes once."""
    rows = spark.readStream.schema(INCOMING).json(folder).withColumn("source_hash", F.sha2("raw_text", 256))
    return rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["source_hash"])


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, newest_year: int, watermark: str = "1 day") -> StreamingQuery:
    """Starts a query that parses what is there and ends. A batch is written under its number, so one that is repeated replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        parse_households(batch.select("id", "raw_text", "confidence"), newest_year).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return text_stream(spark, folder, watermark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(events: DataFrame, time: str, key: str, watermark: str = "1 hour") -> DataFrame:
    """Events per key in windows of an hour; rows later than the watermark are dropped. Works on streams and tables alike."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, "1 hour"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), key, "n")
