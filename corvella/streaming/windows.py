"""Extension: streaming twins of batch queries on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str = "1 day", late: str = "1 hour", watermark: bool = False) -> DataFrame:
    """Counts and sums a window and type; the same call takes a stream or a table."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, time: str, width: str = "7 days", step: str = "1 day") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, gap: str = "30 minutes") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def dedup(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def upsert_sink(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Append-replace by partition for each micro-batch; a batch written twice leaves the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
