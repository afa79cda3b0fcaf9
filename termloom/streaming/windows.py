"""Structured Streaming: windowed counts with a watermark, replay of stored rows, decayed folding of patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.operators.counts import epoch_seconds
from termloom.operators.mining import MIN_SUPPORT, fold, frequent
from termloom.sources.shared import shared_path


def replay(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stored table as a stream of so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, size: str, step: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of tumbling or sliding windows. Rows later than the watermark are dropped; a window is emitted once, when
    the watermark passes its end."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(F.window(ts, size, step or size).alias("w"), *keys).agg(F.count("*").alias("freq"))


def drained(counts: DataFrame, path: str | None = None) -> DataFrame:
    """Runs a windowed stream over all that is there now and returns all windows emitted so far (window_start, keys, freq).

    Output and state live under `path` (a fresh one in the shared folder by default): a later call with the same path
    goes on after the last batch, also when a driver was lost in between.
    """
    spark = counts.sparkSession
    path = path or shared_path(spark)
    keys = [c for c in counts.columns if c not in ("w", "freq")]
    flat = counts.select(F.col("w.start").alias("start"), *keys, "freq")
    query = flat.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(flat.schema).parquet(f"{path}/out")
    return rows.select(epoch_seconds(F.col("start").cast("timestamp_ntz")).alias("window_start"), *keys, "freq")


PATTERNS = "items array<string>, support long"


def folded_patterns(stream: DataFrame, to_transactions: Callable[[DataFrame], DataFrame], min_support: int = MIN_SUPPORT, path: str | None = None) -> DataFrame:
    """Patterns of a stream of blocks: each batch is mined and the older patterns are folded in, decayed by one window.

    The patterns after batch n are the table patterns/n under `path`, written before the batch is committed; a batch that
    runs again after a loss reads table n - 1 and writes table n anew. So a later call with the same path goes on.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark)
    path = path or shared_path(spark)
    at = lambda n: f"{path}/patterns/{n}"

    def block(batch: DataFrame, number: int) -> None:
        new = frequent(to_transactions(batch), min_support)
        old = spark.read.schema(PATTERNS).parquet(at(number - 1)) if number else None
        (fold(new, old, 1) if old is not None else new).write.mode("overwrite").parquet(at(number))
        spark.range(1).select(F.lit(number).cast("long").alias("block")).write.mode("overwrite").parquet(f"{path}/done/{number}")

    query = stream.writeStream.foreachBatch(block).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        last = spark.read.schema("block long").option("recursiveFileLookup", True).parquet(f"{path}/done").agg(F.max("block")).first()[0]
    except AnalysisException:  # no batch so far
        return spark.createDataFrame([], PATTERNS)
    return spark.read.schema(PATTERNS).parquet(at(last))
