"""Streams: chunks arriving as files are indexed as they come; events in windows; the latest status of every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.index import Tokenizer, keyword_postings


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 2) -> DataFrame:
    """Parquet files under ``path`` as a stream, so many per micro-batch: the queue with its number of workers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_stream(stream: DataFrame, key: str, text: str, target: str, checkpoint: str, tokenizer: Tokenizer = tokens):
    """Appends the postings (term, id, tf, dl) of every micro-batch to ``target``; a batch that comes twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        keyword_postings(batch.dropDuplicates([key]), key, text, tokenizer).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; works on a batch and, with the watermark, on a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: events no more than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest_status(events: DataFrame, key: str = "task_id", order: str = "seq", status: str = "status") -> DataFrame:
    """The last status of every task: a pre-aggregated ``max_by``, not a sort."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.max(order).alias(order))
