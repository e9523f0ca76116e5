"""Structured Streaming forms of the batch operators: event time, watermarks and keyed state."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events as a stream of files, with a zoned event time as watermarks ask for."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("at", F.timestamp_seconds(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))))


def daily_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per UTC day and kind; rows later than the watermark are left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("day_start"), "event_type", "n")


def sliding_counts(stream: DataFrame, size: str = "5 days", slide: str = "2 days", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.window("at", size, slide)).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """A user's sessions: events at most `gap` apart."""
    s = stream.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


def distinct_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def followed(stream: DataFrame, first: str, then: str, within: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """A user's events of one kind and their events of another at most `within` later: both sides wait no longer than that."""
    a = stream.filter(F.col("event_type") == first).withWatermark("at", late).select("user_id", F.col("event_id").alias("first_id"), F.col("at").alias("first_at"))
    b = stream.filter(F.col("event_type") == then).withWatermark("at", late).select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("at").alias("then_at"))
    near = (F.col("user_id") == F.col("_user")) & (F.col("then_at") > F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "first_id", "then_id", (F.unix_seconds("then_at") - F.unix_seconds("first_at")).alias("gap"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's results and state, in the folder that spark.checkpoint.dir names. Where it is unset, a session
    on this machine alone gets a temporary one; a cluster has no other folder that all its machines share, and is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="chorale-stream-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}"


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What the stream gives once all files there are have been read, as a table that its executors wrote: nothing passes
    through the driver. In complete mode the last batch is the whole result."""
    spark = stream.sparkSession
    folder = _folder(spark, name)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "complete":
        query = writer.foreachBatch(keep).start()
    else:
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
