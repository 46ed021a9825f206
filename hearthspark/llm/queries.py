"""The subpackage's queries, one opN_<name> per operator, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm import collocations, decontaminate, htmltext, infill, licenses, oracles, sampling, secrets, sharding, simhash, topk, toxicity, urlfilter, warc
from hearthspark.sources.tables import table, tables


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, bench))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.archive(table(spark, sf_dir, "pages")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(*tables(spark, sf_dir, "documents", "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.digest(sampling.encode_samples(table(spark, sf_dir, "documents"), with_ids=False))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scans, op2_simhash_near_dedup, op3_decontamination, op4_warc, op5_url_filters, op6_toxicity, op7_sharding, op8_exact_top_k, op9_html_extraction,
    op10_sentencepiece, op11_phrase_collocations, op12_license_scans, op13_fill_in_middle,
)}
ORACLES: dict[str, str] = {"op1_secret_scans": oracles.SECRETS, "op3_decontamination": oracles.DECONTAMINATION, "op4_warc": oracles.WARC, "op5_url_filters": oracles.URLS, "op7_sharding": oracles.SHARDS, "op8_exact_top_k": oracles.TOP_K, "op11_phrase_collocations": oracles.COLLOCATIONS, "op12_license_scans": oracles.LICENSES, "op13_fill_in_middle": oracles.INFILL}
