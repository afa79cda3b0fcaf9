"""From raw documents to mixed shards: five stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import shared_dir
from termloom.llm.decontaminate import decontaminate
from termloom.llm.jaccard import drop_near_copies
from termloom.llm.mixing import mix_sources
from termloom.llm.quality import keep_quality
from termloom.llm.sharding import shard


# Every stage takes documents (doc_id, text, lang, source, n_chars) and keeps extra columns, whatever their names.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null, empty and blank texts are rejected; very long ones are judged whole; repeated
    rows all stay or all go; nulls in other columns stay; an empty table stays empty."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id. Of rows with one id the one with the smallest
    text stays; rows with a null id, a null text or no words stay; very long texts are compared whole; an empty table
    stays empty."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items, n_chars following the text; a document of which no word is left
    goes. Null and empty texts, repeated rows and nulls elsewhere stay as they are, as does everything where there is no
    item; very long texts are scanned whole; an empty table stays empty."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights. A null source is a source; null and
    negative n_chars count 0, and a source without size goes; equal rows take each other's place; null ids and texts pass
    through; an empty table stays empty."""
    return mix_sources(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of their shard, one partition each. Null ids come first; null and empty texts weigh a
    byte; equal rows stay together; a text larger than a shard makes its shard larger; an empty table gets the column."""
    return shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: Signatures, suffix automata and sampled splitters have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
