"""Durable intermediate tables in the folder that all executors share, and joins that check a size before they broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of (key, number) that are sent to every executor in a join; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
_OWN: set[str] = set()


def _forget(root: str) -> None:
    """Deletes the folder of this application; a scheme that pyarrow doesn't know is left to the cluster's own cleaning."""
    try:
        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        fs.delete_dir(path)
    except (OSError, pyarrow.ArrowException):
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine.

    Off local masters an unset folder is an error: a machine-local one would lose what the other machines write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.mkdtemp(prefix="termloom-")).as_uri()
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, under one folder for each application, which is deleted when its driver ends."""
    own = f"{shared_root(spark)}/termloom/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_forget, own)
    return f"{own}/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._at = path
    return held


def drop_table(held: DataFrame) -> None:
    """Deletes a table() that nothing reads any more, such as the last round of an iteration."""
    _forget(held._at)


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored side of a join: broadcast when it has at most `limit` rows, left to shuffle otherwise."""
    return F.broadcast(side) if side.count() <= limit else side.hint("merge")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its 1-based place in a total order, by range partitions and their sizes: no task sees all rows."""
    placed = table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").count()  # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")


def accumulated(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with c_sum, the sum of column c over all rows up to this one in a total order, for every c of sums: within
    range partitions, to which the sums of the partitions before are added."""
    placed = table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])  # a row for each task
    whole = whole.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_" + c) for c in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(F.broadcast(whole), "_part")
    return found.withColumns({c + "_sum": F.col("_" + c) + F.sum(c).over(own) for c in sums}).drop("_part", *["_" + c for c in sums])
