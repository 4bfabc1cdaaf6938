"""Tasks, their review, the feedback log and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pending(tasks: DataFrame, decided: DataFrame) -> DataFrame:
    """Tasks that need review and have no decision."""
    return tasks.where("needs_review").join(decided.select("task_id").distinct(), "task_id", "left_anti")


def edited(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks with the last edit's content; ``edits`` has block_id, new_content, pos; edits without a block_id are ignored."""
    last = edits.where("block_id is not null").groupBy("block_id").agg(F.max_by("new_content", "pos").alias("new_content"))
    return blocks.join(last, "block_id", "left").withColumn("was_edited", F.col("new_content").isNotNull()).withColumn("content", F.coalesce("new_content", "content")).drop("new_content")


def transitions(tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """Tasks after their last action: approve or reject (which needs a reason); others keep their status."""
    valid = actions.where("action = 'approve' or (action = 'reject' and length(trim(reason)) > 0)")
    last = valid.groupBy("task_id").agg(F.max_by("action", "seq").alias("action"))
    status = F.when(F.col("action") == "approve", "accepted").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    out = tasks.join(last, "task_id", "left").withColumn("status", status)
    return out.withColumn("needs_review", F.col("needs_review") & F.col("action").isNull()).drop("action")


def _has_edits():
    return F.coalesce(F.size("edited_blocks"), F.lit(0)) > 0


def feedback_totals(feedback: DataFrame) -> DataFrame:
    n = F.count("*")
    approved, rejected, edits = F.count_if(F.col("action") == "approve"), F.count_if(F.col("action") == "reject"), F.count_if(_has_edits())
    share = lambda c: F.when(n > 0, F.round(c / n, 3))
    return feedback.agg(n.alias("total_actions"), approved.alias("approved"), rejected.alias("rejected"), edits.alias("with_edits"), share(approved).alias("approval_rate"), share(edits).alias("edit_rate"))


def feedback_block_types(feedback: DataFrame, k: int = 10) -> DataFrame:
    """The most edited block types; those not stated are unknown. Ties by name."""
    kinds = feedback.select(F.explode("edited_blocks").alias("e")).select(F.coalesce("e.block_type", F.lit("unknown")).alias("block_type"))
    return kinds.groupBy("block_type").agg(F.count("*").alias("edits")).orderBy(F.desc("edits"), "block_type").limit(k)


def feedback_by_file(feedback: DataFrame) -> DataFrame:
    name = F.coalesce("filename", F.lit("unknown")).alias("filename")
    return feedback.groupBy(name).agg(F.count("*").alias("actions"), F.count_if(_has_edits()).alias("edits"), F.round(F.avg((F.col("action") == "approve").cast("double")), 6).alias("approve_rate"))


def recent_feedback(feedback: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` entries in the order of the log, 0 for all."""
    return feedback if k == 0 else feedback.orderBy(F.desc("seq"), "task_id").limit(k)


def queue_positions(tasks: DataFrame, waiting: str = "queued") -> DataFrame:
    """``task_id``, ``position``: 1-based place of each waiting task in the order it came; shards are ranked, then offset, so no task holds the queue."""
    rows = tasks.where(F.col("status") == waiting).select("task_id", "seq")
    shard = F.floor(F.col("seq") / 4096)
    rows = rows.withColumn("shard", shard)
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per 4096 tasks
    place = F.row_number().over(W.partitionBy("shard").orderBy("seq", "task_id"))
    return rows.withColumn("place", place).join(before.select("shard", "before"), "shard").select("task_id", (F.col("before") + F.col("place")).cast("bigint").alias("position"))


def task_status(tasks: DataFrame, task_id: str | Column) -> DataFrame:
    """The one task asked for, with the defaults of missing fields and its place in the queue; an error if there is none."""
    place = queue_positions(tasks)
    rows = tasks.where(F.col("task_id") == task_id).join(place, "task_id", "left")
    return rows.select("task_id", "status", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("filename", ""), ("error", ""), ("indexed_count", 0), ("chunk_count", 0), ("total_pages", 0), ("needs_review", False)) if c in tasks.columns], F.col("position").alias("queue_position"), (F.col("status") == "processing").alias("is_processing"))


def listed(tasks: DataFrame) -> DataFrame:
    """All tasks with their place in the queue, the latest id first."""
    return tasks.join(queue_positions(tasks), "task_id", "left").withColumnRenamed("position", "queue_position").orderBy(F.desc("task_id"))


def review_details(tasks: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """A nested row per task: its pages with their blocks in order, its chunks, and defaults for what is missing.

    ``blocks``: doc_id, page_num, block_idx, block_id, content, block_type, confidence; ``chunks``: doc_id, chunk_seq, chunk_id, content, metadata. A
    task's pages and chunks meet in one row, as the payload for one task; pages are built first.
    """
    d = lambda c, v: F.coalesce(c, F.lit(v))
    block = F.struct("block_idx", d("block_id", "").alias("block_id"), d("content", "").alias("content"), d("block_type", "text").alias("block_type"), F.col("page_num"), d("confidence", 0.0).alias("confidence"), F.lit(True).alias("editable"))
    pages = blocks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.sum(F.length(d("content", ""))).alias("text_length"))
    pages = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "blocks", "text_length"))).alias("pages"))
    m = lambda c, v: F.coalesce(F.col(f"metadata.{c}"), F.lit(v)).alias(c)
    path = F.coalesce("metadata.layout_tree_path", F.array().cast("array<string>")).alias("layout_tree_path")
    chunk = F.struct("chunk_seq", d("chunk_id", "").alias("chunk_id"), d("content", "").alias("content"), m("source_file", ""), m("page_num", 0), m("section", ""), m("chunk_type", "text"), path)
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.count("*").alias("total_chunks"))
    return tasks.join(pages, "doc_id", "left").join(listed, "doc_id", "left").withColumn("total_chunks", d("total_chunks", 0))


def requeued(tasks: DataFrame, again: DataFrame) -> DataFrame:
    """Tasks after those in ``again(task_id)`` are sent through the queue once more: queued, without error, without review; a task without a file stays as it is."""
    mark = again.select("task_id").distinct().withColumn("_again", F.lit(True))
    hit = F.coalesce(F.col("_again"), F.lit(False)) & (F.coalesce(F.col("file_path"), F.lit("")) != "")
    rows = tasks.join(mark, "task_id", "left").withColumn("_hit", hit)
    out = {"status": F.when(F.col("_hit"), "queued").otherwise(F.col("status")), "needs_review": F.col("needs_review") & ~F.col("_hit"), "error": F.when(F.col("_hit"), "").otherwise(F.col("error"))}
    return rows.withColumns(out).drop("_again", "_hit")


def queue_lists(tasks: DataFrame, max_concurrent: int = 2, most: int = 100) -> DataFrame:
    """One row: how many tasks run and wait, which run, and which wait first, at most ``most`` of each named."""
    rows = tasks.where(F.col("status").isin("processing", "queued")).select("task_id", "seq", "status")
    running, waiting = F.col("status") == "processing", F.col("status") == "queued"
    counts = rows.agg(F.count_if(running).alias("running_count"), F.count_if(waiting).alias("waiting_count"))
    out = counts.withColumn("max_concurrent", F.lit(max_concurrent))
    for name, kind in (("running", running), ("waiting", waiting)):
        first = rows.where(kind).orderBy("seq", "task_id").limit(most).agg(F.array_sort(F.collect_list(F.struct("seq", "task_id"))).alias("l"))
        out = out.crossJoin(F.broadcast(first.select(F.col("l.task_id").alias(name))))  # one row each
    return out


def evaluated(answers: DataFrame, items: DataFrame) -> DataFrame:
    """One row: how many items were asked and passed, the pass rate, mean confidence and citations.

    ``items``: q, key_terms; ``answers``: q, answer, citations, confidence. An item passes if any of its terms stands in the answer, whatever its case, and there is a citation.
    """
    text = F.lower(F.coalesce("answer", F.lit("")))
    hit = F.exists("key_terms", lambda t: F.contains(text, F.lower(t))) & (F.coalesce("citations", F.lit(0)) >= 1)
    rows = items.join(answers, "q", "left").withColumn("passed", F.coalesce(hit, F.lit(False)))
    share = F.when(F.count("*") > 0, F.round(F.avg(F.col("passed").cast("double")), 6)).otherwise(0.0)
    return rows.agg(F.count("*").alias("asked"), F.count_if("passed").alias("passed"), share.alias("pass_rate"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence"), F.round(F.avg(F.coalesce("citations", F.lit(0))), 6).alias("avg_citations"))
