"""Streams of events: exact duplicates within the watermark, one-second slots, daily activity, and idempotent ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str, schema: str, ts: str = "ts", late: str = "10 minutes", files: int = 1) -> DataFrame:
    """A file stream whose event time has a zone and a watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def distinct_events(stream: DataFrame, key: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, by: str, ts: str = "ts", period: str = "1 day") -> DataFrame:
    """Events and their value by period; batch and stream give the same rows."""
    return stream.groupBy(by, F.window(ts, period).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(by, F.col("w.start").alias("period"), "n", "value")


def lookback(stream: DataFrame, by: str, ts: str = "ts", length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Counts over sliding windows."""
    return stream.groupBy(by, F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest(target: str, key: list[str], marker: str | None = None, day: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that adds rows whose key the target lacks: a batch that runs twice adds nothing.

    With ``day``, a column that a key never changes, the target is laid out by it, and a batch reads the keys of its own days
    only: what it costs follows the batch, not the target. With ``marker``, rows where it is false (findings) are written before
    those where it is true (result markers)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key).persist()
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        new = rows
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.schema(batch.schema).parquet(target)
            if day:
                # folders of other days are pruned when the batch's days are known
                held = held.join(rows.select(day).distinct(), day, "left_semi")
            new = rows.join(held.select(*key), key, "left_anti").persist()
        parts = [new] if marker is None else [new.where(~F.col(marker)), new.where(F.col(marker))]
        for part in parts:
            writer = part.write.mode("append")
            (writer.partitionBy(day) if day else writer).parquet(target)
        new.unpersist()
        rows.unpersist()

    return write


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there and stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query
