"""Sharding by sampled splitters.

A row enters the sample with probability in proportion to its size, so the quantiles of the sampled keys cut
the table into ranges of about equal size. Exact range sizes are then counted over all rows; a range over its
limit is sampled again and subdivided, until no range that is over its limit can be cut. Keys are pairs of the key
column and a hash of the row, so a hot key can be cut as well. All this reads a narrow table (key, hash, size) that is
made in one scan; in a second scan the rows move once, each straight to the partition of its range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import free_name, quoted, stored

#: Bytes of text in a shard; a range may exceed them by SLACK before it is subdivided.
SHARD_BYTES, SLACK = 32 << 20, 1.25
#: Sampled keys for each cut that is wanted, and the most ranges that one range is cut into at once: a task sees so
#: many times so many sampled keys, and the driver only the cuts.
OVERSAMPLE, FANOUT = 24, 512
_LOWEST = -(1 << 63)


class Cuts:
    """Distinct splitters (k, t) in ascending order."""

    def __init__(self, pairs: np.ndarray | None = None) -> None:
        pairs = np.zeros((0, 2), np.int64) if pairs is None else np.unique(pairs, axis=0)
        self.keys, self.ties = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def __len__(self) -> int:
        return len(self.keys)

    def with_more(self, pairs: np.ndarray) -> Cuts:
        return Cuts(np.concatenate((np.stack((self.keys, self.ties), 1), pairs)))

    def range_of(self, spark: SparkSession, key: Column, tie: Column) -> Column:
        """Number of splitters (k, t) with (k, t) <= (key, tie): the range of the row. Null keys come first."""
        if not len(self):
            return F.lit(0)
        sent = spark.sparkContext.broadcast((self.keys, self.ties))  # 16 bytes for each range

        @F.pandas_udf("int")
        def find(k: pd.Series, t: pd.Series) -> pd.Series:
            keys, ties = sent.value
            k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            at = high.copy()
            for first in np.unique(low[low < high]):
                rows = np.flatnonzero((low == first) & (high > first))
                at[rows] = first + np.searchsorted(ties[first : high[rows[0]]], t[rows], "right")
            return pd.Series(at.astype(np.int32))

        return find(F.coalesce(key, F.lit(_LOWEST)), tie)


def _quantiles(found: pd.DataFrame) -> pd.DataFrame:
    """At most parts - 1 distinct splitters that cut the weighted sample of a range into equal shares."""
    found = found.sort_values(["k", "t"], kind="stable")
    parts = int(found["parts"].iloc[0])
    seen = found["w"].cumsum().to_numpy()
    at = np.searchsorted(seen - found["w"].to_numpy(), seen[-1] * np.arange(1, parts) / parts, "left")
    return found.iloc[np.unique(at[at < len(found)])][["k", "t"]].drop_duplicates()


def splitters(rows: DataFrame, shard_bytes: int = SHARD_BYTES, slack: float = SLACK, oversample: int = OVERSAMPLE, seed: int = 11) -> Cuts:
    """Cuts between the ranges of a stored table (k, t, s) of keys, row hashes and sizes."""
    cuts, turn = Cuts(), 0
    while True:
        ranged = rows.withColumn("r", cuts.range_of(rows.sparkSession, F.col("k"), F.col("t")))
        held = ranged.groupBy("r").agg(F.sum("s").alias("b")).where(F.col("b") > shard_bytes * (slack if turn else 1.0))
        large = stored(held.select("r", "b", F.least(F.ceil(F.col("b") / shard_bytes), F.lit(FANOUT)).cast("int").alias("parts")))
        if large.isEmpty():
            return cuts
        # a row of s bytes is drawn with probability min(1, s * oversample * parts / bytes of the range) and stands for s / p bytes
        p = F.least(F.lit(1.0), F.col("s") * F.lit(float(oversample)) * F.col("parts") / F.col("b"))
        draw = (F.xxhash64(F.lit(seed + turn), "k", "t") % (1 << 40) + (1 << 40)) / float(1 << 41)
        drawn = ranged.join(F.broadcast(large), "r").where(draw < p).select("r", "k", "t", (F.col("s") / p).alias("w"), "parts")
        more = cuts.with_more(drawn.groupBy("r").applyInPandas(_quantiles, "k long, t long").toPandas().to_numpy(np.int64).reshape(-1, 2))
        if len(more) == len(cuts):  # the ranges that are left hold one key and hash, or one text beyond the limit
            return cuts
        cuts, turn = more, turn + 1


def shard(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """docs with an int column `shard` (shard_ if that is taken), range-partitioned: one partition a shard, sorted by key.

    The key is an integer column. Null keys sort before all others; empty and null texts weigh one byte; a text
    larger than a shard has a range to itself, or shares it with few others; rows with one key are kept apart
    by their hash, equal rows stay together. Other columns, whatever their names, pass through. An empty table gets
    the column and no rows. At 100 TB the default makes 3 million ranges: 48 MB of cuts, on the driver and broadcast.
    """
    key, tie = quoted(key_col).cast("long"), F.xxhash64(*[quoted(c) for c in docs.columns])
    size = F.greatest(F.coalesce(F.octet_length(quoted(text_col).cast("string")).cast("long"), F.lit(0)), F.lit(1))
    cuts = splitters(stored(docs.select(F.coalesce(key, F.lit(_LOWEST)).alias("k"), tie.alias("t"), size.alias("s"))), shard_bytes, **options)
    name = free_name(docs, "shard")
    out = docs.withColumn(name, cuts.range_of(docs.sparkSession, key, tie))
    return out.repartitionById(len(cuts) + 1, quoted(name)).sortWithinPartitions(quoted(key_col).asc_nulls_first(), tie)
