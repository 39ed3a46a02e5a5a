"""Churn as a stream: events by file in tumbling windows, late rows dropped by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.store import workspace


def windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(path, start, commits, insertions) of events(ts, event_type, value), streaming or not."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("path"))
    return w.agg(F.count("*").alias("commits"), F.sum(F.round("value").cast("long")).alias("insertions")).select("path", F.col("w.start").alias("start"), "commits", "insertions")


def replay(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Streams the files called name under folder once, to the end, and returns the last state of every window."""
    where = workspace(spark, "churn")
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/state")

    q = windows(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/state")
