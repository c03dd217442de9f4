"""Micro-batches whose output survives a restart: each is written to a folder of its own number, and once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.sources.places import exists


def _number(path: str, batch: int) -> str:
    return f"{path}/batch_id={batch}"


def run(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str, after_write: Callable[[int], None] | None = None) -> None:
    """Apply `work` to the rows of a stream, micro-batch by micro-batch, until what is there is used up.

    Batch n replaces the folder batch_id=n under `path`, so a batch that is replayed after a crash between its
    write and its commit adds nothing. Rows whose key an earlier batch has written are left out, as are repeats of a key within
    a batch (the least row stays), so a second run over the same input resumes instead of starting again.
    after_write is called between the write and the commit.
    """
    spark = rows.sparkSession

    def batch(found: DataFrame, number: int) -> None:
        own = found.sparkSession
        order = [c for c in found.columns if c != key]
        found = found.groupBy(key).agg(F.min(F.struct(*order)).alias("row")).select(key, "row.*")
        if exists(own, path):
            done = own.read.option("basePath", path).parquet(path).where(F.col("batch_id") != number)
            found = found.join(done.select(key), key, "left_anti")
        work(found).write.mode("overwrite").parquet(_number(path, number))
        if after_write:
            after_write(number)

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, path: str) -> DataFrame:
    """What `run` has written, with batch_id."""
    return spark.read.parquet(path)
