"""Incremental indexes: micro-batches are assigned to lists and appended; windows of slices drop the oldest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.ivf import IVF


def add_stream(vectors: DataFrame, index: IVF, path: str, checkpoint: str):
    """A started query that appends each micro-batch of vectors to the index's table. A batch's files are its own
    folder's, overwritten when it is replayed, so each vector is there once."""

    def put(batch: DataFrame, number: int) -> None:
        index.encode(index.assign(batch)).write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/batch={number}")

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lists(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def slide(slices: DataFrame, n: int) -> DataFrame:
    """The newest n slices of a table with slice_no."""
    last = slices.agg(F.max("slice_no").alias("last_"))
    return slices.crossJoin(F.broadcast(last)).where(F.col("slice_no") > F.col("last_") - n).drop("last_")
