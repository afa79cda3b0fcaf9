"""Readers and writers of the text formats around mining and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from termloom.functions.text import html_text, java_escape, java_unescape, mail_time, page_time, tokens
from termloom.operators.counts import summary
from termloom.sources.shared import ranked

MESSAGES = StructType([StructField("id", LongType()), StructField("screen_name", StringType()), StructField("ts", LongType()), StructField("text", StringType())])
HOUR, SLOT = 3_600_000, 300_000


def folder(spark: SparkSession, path: str, kind: str, pattern: str = "*", **options: str) -> DataFrame:
    """All files of a folder tree whose names match, as one table."""
    return spark.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup="true", **options).load(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated messages with a header line; short rows and bad numbers are dropped, escapes undone."""
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 4)
    rows = rows.select(F.expr("try_cast(f[0] as bigint)").alias("id"), F.col("f")[1].alias("screen_name"), F.expr("try_cast(f[2] as bigint)").alias("ts"), java_unescape(F.col("f")[3]).alias("text"))
    return rows.where("id is not null and ts is not null")


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as escaped tab-separated text under hour=/slot= folders; the slot ends after the message."""
    rows = messages.withColumn("hour", slot_of("ts", HOUR)).withColumn("slot", slot_of("ts", SLOT) + SLOT)
    line = F.concat_ws("\t", F.col("id").cast("string"), "screen_name", F.col("ts").cast("string"), java_escape("text"))
    rows.select(line.alias("value"), "hour", "slot").repartition("hour", "slot").write.partitionBy("hour", "slot").text(path)


def slot_of(ts: str, size: int):
    return (F.floor(F.col(ts) / size) * size).cast("long")


def read_slots(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Messages of start <= ts <= end; folders outside are never opened."""
    rows = spark.read.text(path).where((F.col("hour") >= start // HOUR * HOUR) & (F.col("hour") <= end) & (F.col("slot") > start) & (F.col("slot") <= end + SLOT))
    parts = F.split("value", "\t")
    rows = rows.select(F.expr("try_cast(split(value, '\t')[0] as bigint)").alias("id"), parts[1].alias("screen_name"), F.expr("try_cast(split(value, '\t')[2] as bigint)").alias("ts"), java_unescape(parts[3]).alias("text"))
    return rows.where(F.col("ts").between(start, end))


def page_messages(pages: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """(id, screen_name, ts, text) of pages (id, screen_name, http_status, html): of status below 300, with a text and a
    time, and an id that isn't denied."""
    rows = pages.where("http_status < 300 and html <> ''")
    if denied is not None:
        rows = rows.join(denied.select("id").distinct(), "id", "left_anti")
    found = rows.select("id", "screen_name", page_time(F.col("html")).alias("ts"), html_text(F.col("html"), "entry-content", "entry-meta").alias("text"))
    return found.where("ts is not null and text <> ''")


def status_histogram(pages: DataFrame) -> DataFrame:
    """(status, n): of pages; 0 for a good one without text, -1 for one without a time."""
    good = F.col("http_status") < 300
    text = html_text(F.col("html"), "entry-content", "entry-meta")
    status = F.when(good & F.coalesce(text == "", F.lit(True)), 0).when(good & page_time(F.col("html")).isNull(), -1).otherwise(F.col("http_status"))
    return pages.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def denied_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): of lines `id status`, those of a status other than 200 or 301."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].alias("id"), parts[1].alias("s")).where("s not in ('200', '301')").select("id")


def read_grouped(spark: SparkSession, path: str, regex: str, keys: list[int], value: int, fields: int = 4) -> tuple[DataFrame, DataFrame]:
    """(key columns k0.., member) of lines with exactly so many fields, and the count of the other lines."""
    rows = spark.read.text(path).select(F.split("value", regex).alias("f"))
    good = rows.where(F.size("f") == fields).select(*[F.col("f")[k].alias(f"k{i}") for i, k in enumerate(keys)], F.col("f")[value].alias("member"))
    return good, rows.agg(F.count(F.when(F.size("f") != fields, 1)).alias("bad"))


def read_topics(spark: SparkSession, path: str, chronological: bool = False) -> DataFrame:
    """(qid, query, query_ts, max_id) of <top> entries; a title stands in for the query, the number is what follows a colon."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?i)<top>")).alias("t"))
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("t", f"(?is)<{tag}>(.*?)(?:</{tag}>|<|$)", 1)), F.lit(""))
    rows = whole.select(F.trim(F.substring_index(part("num"), ":", -1)).alias("qid"), F.coalesce(part("title"), part("query")).alias("query"), mail_time(part("querytime")).alias("query_ts"), part("querytweettime").try_cast("long").alias("max_id"))
    rows = rows.where("qid is not null and query is not null")
    return rows.orderBy("query_ts", "qid") if chronological else rows


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of lines `qid x doc rel`; short lines and judgements that are no number are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("qid"), parts[2].alias("doc_id"), parts[3].try_cast("double").alias("rel")).where("rel is not null")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(run, qid, doc_id, rank, score) of lines `qid 0 doc rank score tag` or `qid doc score tag`. Equal ranks all stay."""
    f = F.col("f")
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) in (4, 6)")
    six = F.size("f") == 6
    rows = rows.select(F.when(six, F.get(f, F.lit(5))).otherwise(F.get(f, F.lit(3))).alias("run"), f[0].alias("qid"), F.when(six, f[2]).otherwise(f[1]).alias("doc_id"), F.when(six, F.get(f, F.lit(3)).try_cast("int")).alias("given"), F.when(six, F.get(f, F.lit(4)).try_cast("double")).otherwise(f[2].try_cast("double")).alias("score"))
    own = F.row_number().over(Window.partitionBy("run", "qid").orderBy(F.desc("score"), F.desc("doc_id")))
    return rows.withColumn("rank", F.coalesce("given", own)).drop("given")


def write_run(run: DataFrame, path: str, newest_first: bool = False) -> None:
    order = [F.col("qid"), F.desc("doc_id") if newest_first else F.col("rank")]
    line = F.format_string("%s 0 %s %d %s %s", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), F.col("score").cast("string"), F.col("run"))
    run.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """One line for each item: the item, a tab, its patterns with support."""
    best = patterns.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat("items", F.lit(":"), F.col("support").cast("string")).alias("p")))).alias("ps"))
    best.select(F.concat_ws("\t", "item", F.array_join("ps.p", ", ")).alias("value")).write.text(path)


def write_flist(flist: DataFrame, path: str) -> None:
    flist.repartitionByRange(F.desc("freq"), F.col("token")).sortWithinPartitions(F.desc("freq"), "token").select(F.concat_ws("\t", "token", F.col("freq").cast("string")).alias("value")).write.text(path)


def read_flist(spark: SparkSession, path: str) -> DataFrame:
    """(token, freq) of lines that write_flist wrote; others are dropped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f[0].alias("token"), F.get(f, F.lit(1)).try_cast("long").alias("freq"))
    return rows.where("freq is not null")


def flist_lengths(flist: DataFrame) -> DataFrame:
    """One row: n, min, max, mean, variance, sum of the lengths of the tokens."""
    return summary(flist.select(F.length("token").cast("long").alias("chars")), "chars")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(item, rank, items, support) of lines that write_patterns wrote."""
    f = F.split("value", "\t")
    each = spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("item"), F.posexplode(F.split(f[1], ", ")).alias("at", "p"))
    return each.select("item", (F.col("at") + 1).alias("rank"), F.regexp_extract("p", "^(.*):", 1).alias("items"), F.regexp_extract("p", ":([0-9]+)$", 1).try_cast("long").alias("support"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small table of figures as one CSV file with a header."""
    metrics.coalesce(1).write.option("header", True).csv(path)


def slices(docs: DataFrame, id_col: str = "doc_id", per_slice: int = 1000) -> DataFrame:
    """(slice, doc_id, items): token sets of documents in slices of so many, in id order."""
    placed = ranked(docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("items")), [F.col("doc_id")], "place")
    return placed.select(F.floor((F.col("place") - 1) / per_slice).alias("slice"), "doc_id", "items")


def write_arff(sliced: DataFrame, path: str) -> None:
    """A sparse ARFF text for each slice, as slice=N folders: the header lists the slice's terms, rows name their positions."""
    terms = sliced.select("slice", F.explode("items").alias("term")).distinct()
    numbered = terms.withColumn("at", F.row_number().over(Window.partitionBy("slice").orderBy("term")) - 1)
    head = numbered.groupBy("slice").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda t: F.concat(F.lit("@attribute '"), F.replace(t["term"], F.lit("'"), F.lit("\\'")), F.lit("' {T}"))), "\n").alias("a"))
    each = sliced.select("slice", "doc_id", F.explode("items").alias("term")).join(numbered, ["slice", "term"])
    rows = each.groupBy("slice", "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda at: F.concat(at.cast("string"), F.lit(" T"))), ",").alias("r"))
    body = rows.groupBy("slice").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "r"))), lambda r: F.concat(F.lit("{"), r["r"], F.lit("}"))), "\n").alias("b"))
    text = F.concat(F.lit("@relation slice\n"), F.col("a"), F.lit("\n@data\n"), F.col("b"))
    head.join(body, "slice").select("slice", text.alias("value")).write.partitionBy("slice").text(path)


def job_name(**parameters: object) -> str:
    """A folder name that tells a job's parameters."""
    return re.sub(r"[^A-Za-z0-9_.=-]+", "-", "_".join(f"{k}={v}" for k, v in parameters.items()))
