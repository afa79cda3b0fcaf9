"""Inputs shared by the catalogue's queries, and SQL fragments shared by their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import mining, search
from termloom.operators.counts import epoch_seconds
from termloom.sources.shared import table

SUPPORT = 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("sec", epoch_seconds(F.col("ts")))


def part_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.baskets(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent(part_baskets(spark, sf_dir), SUPPORT)


def topic_terms(spark: SparkSession, sf_dir: str, padding: tuple[str, ...] = ()) -> DataFrame:
    return search.query_terms(load(spark, sf_dir, "benchmark"), "item_id", "text", padding=padding)


def posted(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None) -> DataFrame:
    found = search.postings(load(spark, sf_dir, "documents"), only=terms)
    return table(found) if terms is not None else found


def pair_terms(patterns: DataFrame) -> DataFrame:
    """Every frequent pair as a query (qid, term, qw)."""
    pairs = patterns.where("size(items) = 2").select("items", mining.key().alias("k"))
    return table(pairs.select(F.col("k").alias("qid"), F.explode("items").alias("term"), F.lit(1.0).alias("qw")))


def tok(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9#@]+'), lambda x: x <> '')"


SQL_DOCS = f"""docs AS (SELECT doc_id, {tok()} AS t FROM documents),
n AS (SELECT count(*) AS n FROM documents),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n GROUP BY term, n)"""
SQL_TOPICS = f"""qt AS (SELECT qid, term, count(*)::DOUBLE AS qw FROM (SELECT item_id AS qid, unnest({tok()}) AS term FROM benchmark) GROUP BY ALL)"""


def sql_mined(rows: str = "SELECT DISTINCT l_orderkey AS o, l_partkey::VARCHAR AS i FROM lineitem", support: int | str = SUPPORT, name: str = "mined", longest: int = 99) -> str:
    """CTEs (for WITH RECURSIVE) that enumerate the subsets of every basket: name(items list, support)."""
    return f"""{name}_all AS ({rows}),
{name}_e AS (SELECT o, i FROM {name}_all WHERE i IN (SELECT i FROM {name}_all GROUP BY i HAVING count(*) >= {support})),
{name}_s AS (SELECT o, [i] AS items, i AS last FROM {name}_e UNION ALL SELECT s.o, list_append(s.items, e.i), e.i FROM {name}_s s JOIN {name}_e e ON s.o = e.o AND e.i > s.last WHERE len(s.items) < {longest}),
{name} AS (SELECT items, count(*) AS support FROM {name}_s GROUP BY items HAVING count(*) >= {support})"""


SQL_PAIRS = """pq AS (SELECT array_to_string(items, ' ') AS qid, items FROM mined WHERE len(items) = 2),
pt AS (SELECT qid, unnest(items) AS term, 1.0::DOUBLE AS qw FROM pq)"""
SQL_RELATED = f"""WITH RECURSIVE {sql_mined()}, {SQL_PAIRS},
sets AS (SELECT array_to_string(items, ' ') AS items, items AS parts, support FROM mined),
each AS (SELECT items, support, unnest(parts) AS term FROM sets),
sdf AS (SELECT term, count(*) AS df FROM each GROUP BY term),
hit AS (SELECT qid, items, support, round(sum(qw * ln(((SELECT count(*) FROM sets) - df + 0.5) / (df + 0.5))), 6) AS score FROM each JOIN pt USING (term) JOIN sdf USING (term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, support DESC, items DESC) AS rank FROM hit) WHERE rank <= 1000),
member AS (SELECT qid, items, support, rank, term FROM (SELECT qid, items, support, rank, unnest(string_split(items, ' ')) AS term FROM hits WHERE contains(items, ' ')) WHERE (qid, term) NOT IN (SELECT (qid, term) FROM pt))"""
