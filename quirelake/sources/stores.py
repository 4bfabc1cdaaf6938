"""Stores of tasks, feedback, cache entries and indexes, as folders of Parquet or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that an entry of each kind lives.
LIFETIMES = {"embed": 604_800, "rerank": 3_600, "answer": 3_600, "rewrite": 604_800, "crop": 604_800}
TASK = "task_id string, seq bigint, filename string, status string, error string, indexed_count int, chunk_count int, total_pages int, needs_review boolean, confidence double"


def save_tasks(tasks: DataFrame, path: str) -> None:
    """All tasks as JSON lines, in place of what was there."""
    tasks.write.mode("overwrite").json(path)


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK).json(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    """New entries at the end of the log."""
    entries.write.mode("append").parquet(path)


def save_index(postings: DataFrame, path: str, buckets: int = 16) -> None:
    """Postings, partitioned by a hash of their term, so that a query's terms read their parts only."""
    postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(path)


def load_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """Stored postings; with ``terms``, only the parts that hold them are read."""
    rows = spark.read.parquet(path)
    if terms is not None:
        parts = {r.part for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("part")).collect()}  # of the terms given
        rows = rows.where(F.col("part").isin(sorted(parts)) & F.col("term").isin(terms))
    return rows.drop("part")


def clear_index(spark: SparkSession, path: str) -> None:
    """An index without postings in place of what was there."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def landed_name(task_id: Column, filename: Column) -> Column:
    """The name under which an uploaded file is stored, which is its source everywhere."""
    return F.concat(task_id, F.lit("_"), filename)


def cache_entries(rows: DataFrame, kind: str, key: Column, value: Column, now: Column | None = None) -> DataFrame:
    """``ns``, ``key``, ``value``, ``expires_at`` of new entries; an unknown kind is an error, later rows of a key win by value."""
    if kind not in LIFETIMES:
        raise ValueError(f"unknown cache: {kind}")
    now = F.current_timestamp() if now is None else now
    made = rows.select(F.lit(kind).alias("ns"), key.alias("key"), value.cast("string").alias("value"))
    return made.groupBy("ns", "key").agg(F.max("value").alias("value")).withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(LIFETIMES[kind])))


def cached(cache: DataFrame, kind: str, now: Column | None = None) -> DataFrame:
    """The live entries of one kind."""
    now = F.current_timestamp() if now is None else now
    return cache.where((F.col("ns") == kind) & (F.col("expires_at") > now)).select("key", "value")


def deleted(tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The tables (each with source_file) without the rows of one source; rows without a source stay."""
    return {n: t.where(F.coalesce(F.col("source_file") != source, F.lit(True))) for n, t in tables.items()}


def page_documents(blocks: DataFrame) -> DataFrame:
    """A nested row per page for interchange: doc_id, page_num, and its blocks in order."""
    item = F.struct("block_idx", "block_id", "block_type", "content", "bbox", "confidence")
    return blocks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(item)).alias("blocks"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
