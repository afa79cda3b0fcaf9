"""Mixing sources to target weights by systematic sampling.

A source's rate is target share * total size / own size: the copies expected of each of its documents. The
documents of a source stand in the order of a hash of their id; the prefix sum of expected copies, shifted by
one random offset a source, crosses whole numbers as it grows, and each crossing emits the document once. So a
source gets its expected number of copies to within one, and no document is more than one off its own.

The prefix sum is computed in two levels over blocks of the hash order, so a hot source is spread over many
tasks. All sums are of whole units (1e-9 copies), hence exact and independent of the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import BROADCAST_ROWS, free_name, quoted, stored

UNIT = 1_000_000_000
#: Without explicit weights a source weighs its size to this power: large sources are damped, small ones raised.
TEMPERATURE = 0.7
SEED = 13
#: Size of a block of the largest source in the hash order, at most: blocks grow in number with the data, not in size.
BLOCK_SIZE = 8 << 20


def rates(docs: DataFrame, source_col: str, size_col: str, weights: Mapping[str, float] | None, temperature: float, seed: int) -> DataFrame:
    """(source, units expected of each document, offset in units); a source of no size or weight gets 0."""
    source = quoted(source_col).cast("string")
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(F.greatest(F.coalesce(quoted(size_col).cast("long"), F.lit(0)), F.lit(0))).alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(0.0)
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        weight = F.when(F.col("size") > 0, F.coalesce(table[F.col("source")], F.lit(0.0))).otherwise(0.0) if weights else F.lit(0.0)
    sizes = sizes.withColumn("weight", F.round(weight, 3))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    units = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.round(F.col("weight") * F.col("all_size") / F.col("all_weight") / F.col("size") * UNIT)).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    offset = F.floor(draw * UNIT / F.lit(1 << 32)).cast("long")
    return stored(sizes.crossJoin(F.broadcast(total)).select("source", units.cast("long").alias("units"), offset.alias("offset")))


def mix_sources(docs: DataFrame, source_col: str = "source", size_col: str = "n_chars", id_col: str = "doc_id", weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the sampling emits it (often 0 or 1 times), all columns unchanged.

    A null source is a source of its own (weighted by temperature; with explicit weights, like every source
    that they don't name, it gets nothing). Null and negative sizes count as 0 in a source's size. Rows that
    share an id, or whose id is null, are ordered by their size and text hash; equal rows take each other's
    place without changing the result. A source whose sizes are all 0 is left out; an empty table stays empty.
    Texts of any length pass through, as do extra columns whatever their names.
    """
    source, block, order, tie, before, units, offset, copies = (free_name(docs, "mix_" + x) for x in ("source", "block", "order", "tie", "before", "units", "offset", "copies"))
    rate = rates(docs.select(quoted(source_col), quoted(size_col)), source_col, size_col, weights, temperature, seed)
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    rate = rate.where("units > 0").select(named(F.col("source")).alias(source), F.col("units").alias(units), F.col("offset").alias(offset))
    keyed = docs.withColumns({source: named(quoted(source_col)), order: F.md5(F.coalesce(quoted(id_col).cast("string"), F.lit(""))), tie: F.xxhash64(*[quoted(c) for c in docs.columns])})
    # a row counts as at least 64 bytes, so that sources of tiny or unsized rows are cut as well
    most = docs.groupBy(quoted(source_col)).agg(F.sum(F.greatest(F.coalesce(quoted(size_col).cast("long"), F.lit(0)), F.lit(64))).alias("size")).agg(F.max("size")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, most / BLOCK_SIZE), 16)))
    keyed = keyed.withColumn(block, F.substring(quoted(order), 1, digits))
    counts = keyed.groupBy(source, block).count()
    earlier = Window.partitionBy(source).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.withColumn(before, F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(rate, source).drop("count"))
    base = F.broadcast(base) if base.count() <= BROADCAST_ROWS // 8 else base.hint("merge")
    within = Window.partitionBy(source, block).orderBy(order, tie)
    found = keyed.join(base, [source, block]).withColumn(order, (quoted(before) + F.row_number().over(within)).cast("decimal(18,0)"))
    passed = lambda back: F.expr(f"((`{order}` - {back}) * cast(`{units}` as decimal(19, 0)) + `{offset}`) div {UNIT}")
    found = found.withColumn(copies, (passed(0) - passed(1)).cast("int")).where(quoted(copies) > 0)
    return found.withColumn(copies, F.explode(F.sequence(F.lit(1), quoted(copies)))).select(*[quoted(c) for c in docs.columns])


def oracle_sql(table: str = "documents", temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    return f"""
WITH sizes AS (SELECT source, sum(greatest(coalesce(n_chars, 0), 0)) AS size FROM {table} GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN round(pow(size::DOUBLE, {temperature}), 3) ELSE 0.0 END AS weight FROM sizes),
rate AS (SELECT source, CASE WHEN size > 0 THEN round(weight * (sum(size) OVER ())::DOUBLE / sum(weight) OVER () / size * {UNIT}) ELSE 0 END::BIGINT AS units,
  (('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 8))::BIGINT::HUGEINT * {UNIT} // 4294967296)::BIGINT AS shift FROM weighed),
placed AS (SELECT d.*, units, shift, row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.text) AS r
  FROM {table} d JOIN rate ON d.source IS NOT DISTINCT FROM rate.source),
often AS (SELECT *, (r::HUGEINT * units + shift) // {UNIT} - ((r - 1)::HUGEINT * units + shift) // {UNIT} AS copies FROM placed)
SELECT doc_id, text, lang, source, n_chars FROM often, unnest(range(copies::BIGINT)) AS t(i) WHERE copies > 0"""
