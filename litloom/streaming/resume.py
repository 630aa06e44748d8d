"""Incremental runs: what the stages do by appending and skipping what is done, as structured streaming.

An extension: the same contract (each key is processed once, late or repeated input adds nothing), kept
by a checkpoint and a watermark instead of by looking into the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once, within the time that rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))


def append_missing(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the parquet table at ``path`` does not hold; reads all there is, then ends."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
