"""Queries on files that tasks write and read back: workbooks, archives, word tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthspark.operators import household_text
from hearthspark.plans.catalog import ORACLES, query
from hearthspark.plans.more import export_columns
from hearthspark.sources import archives, words, workbooks
from hearthspark.sources.cuts import fresh_dir
from hearthspark.sources.tables import table

c = F.col


@query("export_xlsx", sql=ORACLES["export_columns"])
def export_xlsx(spark, d):
    """The export's thirteen columns as workbooks, read back."""
    workbooks.register(spark)
    root = fresh_dir(spark, "workbooks")
    export_columns(spark, d).write.format("workbooks").mode("append").save(root)
    return spark.read.format("workbooks").load(root)


@query("archive_round_trip", sql="select page_id, octet_length(encode(html)) size, sha256(html) sha256, cast(null as varchar) error from pages")
def archive_round_trip(spark, d):
    """Every page as an entry of an archive, read back by ranges."""
    archives.register(spark)
    root = fresh_dir(spark, "archives")
    entries = table(spark, d, "pages").select(F.concat(F.lit("pages/"), c("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("content"))
    entries.write.format("archives").mode("append").save(root)
    back = spark.read.format("archives").load(root)
    return back.select(F.regexp_extract("name", r"(\d+)\.html", 1).cast("long").alias("page_id"), "size", F.sha2("content", 256).alias("sha256"), "error")


def _word_tables(spark, d, root):
    """Word tables of the conversations, a turn a line, with a header, lines of another level and lines cut short, in archives; read back as (name, tsv)."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("w"))
    conf = lambda i: ((i + 1) * 7 + c("turn")) % 50 + 50
    plain = lambda w: F.regexp_replace(w, r"[\t\n]", "")
    line = lambda w, i: F.concat_ws("\t", *map(F.lit, "5111"), c("turn").cast("string"), i.cast("string"), *[F.lit("0")] * 4, conf(i).cast("string"), plain(w))
    head = F.concat_ws("\t", F.lit("4"), *map(F.lit, "111"), c("turn").cast("string"), F.lit("0"), *[F.lit("0")] * 4, F.lit("-1"), F.lit(""))
    lines = turns.select("conv_id", "turn", F.concat(F.array(head), F.transform("w", line), F.array(F.lit("5\t1\t1\tcut short"))).alias("l"))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "l"))).alias("t")).select("conv_id", F.array_join(F.flatten("t.l"), "\n").alias("tsv"))
    tsv = F.concat(F.lit("\t".join(words.COLUMNS) + "\n"), "tsv")
    archives.register(spark)
    whole.select(F.concat(c("conv_id").cast("string"), F.lit(".tsv")).alias("name"), F.encode(tsv, "utf-8").alias("content")).write.format("archives").mode("append").save(root)
    back = spark.read.format("archives").load(root).filter("error is null")
    return back.select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("conv_id"), F.decode("content", "utf-8").alias("tsv"))


@query("tsv_words_from_files", sql=ORACLES["tsv_words"].replace("unnest(string_split(text,' ')) w", "unnest(list_transform(string_split(text,' '), lambda v: replace(replace(v, chr(9), ''), chr(10), ''))) w"))
def tsv_words_from_files(spark, d):
    """Word tables in archives to texts."""
    tables = _word_tables(spark, d, fresh_dir(spark, "words"))
    return household_text.tsv_text(words.read_words(tables, "conv_id"), "conv_id")


@query("tsv_line_counts", sql="select conv_id, cast(sum(len(string_split(text,' '))) as bigint) words, count(*)+1 other, count(*) skipped from conversations group by conv_id")
def tsv_line_counts(spark, d):
    """Lines of word tables by what they are: words, other levels, cut short."""
    return words.line_counts(_word_tables(spark, d, fresh_dir(spark, "words")), "conv_id")
