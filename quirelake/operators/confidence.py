"""Quality of processed documents in five dimensions, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"layout_quality": 0.25, "ocr_confidence": 0.20, "table_integrity": 0.15, "chunk_coherence": 0.20, "reranker_score": 0.20}


def layout_quality(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("layout_quality"))


def ocr_confidence(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("ocr_confidence"))


def table_integrity(tables: DataFrame) -> DataFrame:
    """1 if all tables have rows and columns, 0.5 if some have, else 0; ``tables`` has doc_id, n_rows, n_cols."""
    good = F.count_if((F.col("n_rows") > 0) & (F.col("n_cols") > 0))
    return tables.groupBy("doc_id").agg(F.when(good == F.count("*"), 1.0).when(good > 0, 0.5).otherwise(0.0).alias("table_integrity"))


def chunk_coherence(chunks: DataFrame) -> DataFrame:
    """The share of chunks with content and metadata."""
    good = (F.coalesce(F.length("content"), F.lit(0)) > 0) & F.col("metadata").isNotNull()
    return chunks.groupBy("doc_id").agg(F.avg(good.cast("double")).alias("chunk_coherence"))


def document_confidence(documents: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """All dimensions a document, 0 where it has no rows, and their weighted sum to 4 digits; the reranker's score is 1 at this stage unless given."""
    out = documents.select("doc_id").distinct()
    for name in WEIGHTS:
        if name in dimensions:
            out = out.join(dimensions[name].select("doc_id", name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        else:
            out = out.withColumn(name, F.lit(1.0 if name == "reranker_score" else 0.0))
    return out.withColumn("overall", F.round(sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)), 4))


def review_decision(scored: DataFrame, indexed: DataFrame, decided) -> DataFrame:
    """Whether a document needs review (not accepted, or nothing indexed), and its status."""
    joined = scored.join(indexed.select("doc_id", "indexed_count"), "doc_id", "left").withColumn("indexed_count", F.coalesce("indexed_count", F.lit(0)))
    out = joined.withColumn("category", decided).withColumn("needs_review", (F.col("category") != "accept") | (F.col("indexed_count") == 0))
    return out.withColumn("status", F.when(F.col("needs_review"), "review").otherwise("indexed"))
