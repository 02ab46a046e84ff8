"""Incremental forms of the event queries: watermarked windows, sessions, latest state, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, with ts as an instant (watermarks refuse local times)."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "24 hours", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame, key: str) -> DataFrame:
    """The last row of each key: a max of structs, kept as state, not a window."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m")).select(key, "m.*")


def to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is there, into a memory table."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def snapshots(df: DataFrame, write, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch's result to ``write(frame, batch_id)``; without ``every`` once over all that is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
