"""Streams over folders of finished log files: each row reaches the sink once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tail_log(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Take the files of a folder of CSV logs that weren't taken yet, append them to a Parquet table, and stop; the checkpoint
    remembers which. For files that no longer grow; growing ones are `growing.follow`'s."""
    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_by_key(stream: DataFrame, key: str, watermark: str, ts: str) -> DataFrame:
    """Rows of a stream without repeats of a key within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
