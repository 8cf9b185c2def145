"""The resumable request log as a stream: bounded micro-batches, each key once, complete batches marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold import store


def request_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """JSON lines that arrive in a folder; at most so many files a batch, which bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def answer_stream(requests: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Answer each batch and append it to ``path``; batches that a restart brings again overwrite their own folder, so a row is there
    once. Keys answered before are not asked again. Requests that fail give no row and come back with the next run's input."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [f"{path}/{n}" for n in store.children(spark, path) if n.startswith("batch=") and n != f"batch={number}"]
        todo = batch.dropDuplicates([key])
        if others:
            done = spark.read.parquet(*others).select(F.col(key).alias("_done")).distinct()
            todo = todo.join(done, F.col(key) == F.col("_done"), "left_anti")
        answer(todo).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the last write to a folder ran to its end."""
    return store.exists(spark, f"{path}/_SUCCESS")


def event_windows(events: DataFrame, time: str, kind: str, value: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum a kind and window of event time; rows later than ``late`` are left out of a stream's windows."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width, slide or width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user, start, end, n)``: runs of a user's events with no pause of ``gap``."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
