"""From candidates to an answer: expansion, reranking, context packing, confidence, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE, rfind, token_estimate
from ..session import keep
from .index import among, fused, ranked

RERANK_POOL = 10
#: Function words that carry no meaning for expansion.
STOP_WORDS = (
    "的 了 是 在 和 与 及 或 等 中 上 下 为 对 以 将 从 到 通过 包括 以及 采用 提供 进行 可以 需要 支持 相关 一个 一种 这些 那些 该 此 这个 我们 本文 "
    "使用 具有 用于 主要 如下 说明 例如 其中 同时 并且 或者 如果 那么 由于 因此 根据 基于 方面 内容 对于 关于 一些 很多 非常 更加 来说 情况下 过程中 部分"
).split()
ENDS = ("。", "！", "？", "\n", ".", "!", "?")
CUT_MARK = "\n[内容过长，已截断]"


def domain_terms(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``term``, ``n``, ``rank``: the most frequent words of the candidates' contents that the query doesn't contain.

    Words of one character, stop words and substrings of the query don't count; longer words win ties, then the word itself.
    """
    words = candidates.select("query_id", F.explode(F.split("content", f"{SPACE}+")).alias("term")).where(F.length("term") >= 2)
    words = words.where(~F.col("term").isin(STOP_WORDS)).join(queries.select("query_id", "query"), "query_id").where(~F.contains("query", F.col("term")))
    counts = words.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    order = W.partitionBy("query_id").orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expanded_queries(queries: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """The query with its domain terms appended, if there are at least ``least``."""
    lists = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    joined = queries.join(lists, "query_id", "left")
    return joined.select("query_id", F.when(F.size("t") >= least, F.concat_ws(" ", "query", F.array_join(F.col("t.term"), " "))).otherwise(F.col("query")).alias("rerank_query"))


def lexical_score(query: Column, content: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the logistic of four times the share of the query's words in the content, less two."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), f"{SPACE}+"), lambda w: w != ""))
    share = F.size(F.filter(words, lambda w: F.contains(F.lower(content), w))) / F.greatest(F.size(words), F.lit(1))
    return 1 / (1 + F.exp(-(4 * share - 2)))


def reranked(candidates: DataFrame, queries: DataFrame, k: int = 10, pool: int = RERANK_POOL, scorer: Callable[[Column, Column], Column] | None = lexical_score) -> DataFrame:
    """The ``pool`` best candidates (query_id, id, rank, content) by ``scorer(query, content)``, ties by the rank before; never more than ``pool``.

    A candidate that the scorer gives null comes after all scored ones. Without a scorer the candidates keep their order and scores and aren't cut to the pool.
    """
    if scorer is None:
        return candidates.where(F.col("rank") <= k)
    joined = candidates.where(F.col("rank") <= pool).join(queries.select("query_id", F.col("query").alias("q")), "query_id")
    return reordered(rescored(joined, scorer).drop("q"), k)


def rescored(joined: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """Candidates, each with its query ``q``: their ``score`` by ``scorer``, and as ``before`` the rank they had."""
    return joined.withColumnRenamed("rank", "before").withColumn("score", F.round(scorer(F.col("q"), F.col("content")), 6))


def reordered(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of every query by ``score``, ties by the rank ``before``."""
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Results up to which they are sent to the contents, which then stay where they are.
SENT_RESULTS = 100_000


def with_contents(results: DataFrame, contents: DataFrame) -> DataFrame:
    """``results``, best kept, with the contents of their ids; of contents that no result has, none is shuffled where results are few, and only a small part where they are many."""
    return contents.join(F.broadcast(results), "id") if results.count() <= SENT_RESULTS else results.join(among(contents, "id", results), "id")


def retrieve(first: DataFrame | None, second: DataFrame | None, contents: DataFrame, queries: DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] | None = lexical_score) -> DataFrame:
    """From two rankings (query_id, id, rank) to the reranked results with content and metadata; a search that failed is None: one alone is fused with nothing, none gives no rows."""
    known = first if first is not None else second
    if known is None:
        none = F.lit(None).cast(dict(queries.dtypes)["query_id"])
        return contents.limit(0).select(none.alias("query_id"), "*", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    nothing = known.limit(0)
    both = fused(first if first is not None else nothing, second if second is not None else nothing, 30)
    return reranked(with_contents(keep(both.select("query_id", "id", "score", "rank")), contents), queries, k, scorer=scorer)


def context_header(m: str = "metadata") -> Column:
    section = F.when(F.coalesce(F.col(f"{m}.section"), F.lit("")) != "", F.concat(F.lit(" | §"), F.col(f"{m}.section"))).otherwise("")
    return F.concat(F.lit("[来源: "), F.coalesce(f"{m}.source_file", F.lit("")), F.lit(" | 第"), F.coalesce(F.col(f"{m}.page_num").cast("string"), F.lit("0")), F.lit("页"), section, F.lit(" | 类型: "), F.coalesce(f"{m}.chunk_type", F.lit("text")), F.lit("]"))


def context_block(content: str = "content", m: str = "metadata") -> Column:
    """The content between two lines that name its source; as it is, without metadata."""
    return F.when(F.col(m).isNull(), F.col(content)).otherwise(F.concat_ws("\n", context_header(m), F.col(content), context_header(m)))


def truncated(text: Column, max_tokens: int) -> Column:
    """At most two characters a token, cut after the last boundary if that lies in the second half, and marked."""
    most = 2 * max_tokens
    head = F.substring(text, 1, most)
    at = F.coalesce(*[F.when(rfind(head, e) > most // 2, rfind(head, e)) for e in ENDS])
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.coalesce(F.substring(head, F.lit(1), at + 1), head), F.lit(CUT_MARK)))


def block_cost() -> Column:
    """What a result's block takes of the budget."""
    return token_estimate(F.concat(context_block(), F.lit("\n\n")))


def used_budget(costed: DataFrame) -> DataFrame:
    """``costed`` (query_id, rank, cost, ...) with ``used``: what a result and those before it take of the budget."""
    line = W.partitionBy("query_id").orderBy("rank")
    return costed.withColumn("used", F.sum("cost").over(line.rowsBetween(W.unboundedPreceding, 0)) + F.greatest(F.col("rank") - 2, F.lit(0)))


def packed_costs(costed: DataFrame, max_tokens: int = 3600) -> DataFrame:
    """``packed_context`` without the blocks, of results (query_id, rank, id, cost) that come without their contents: query_id, rank, id, used."""
    return used_budget(costed).where((F.col("used") <= max_tokens) | ((F.col("rank") == 1) & (F.col("used") > max_tokens))).select("query_id", "rank", "id", "used")


def packed_context(results: DataFrame, max_tokens: int = 3600) -> DataFrame:
    """The leading results of each query that fit the budget, numbered: query_id, rank, id, block, used.

    ``results`` has query_id, rank, id, content, metadata. A block costs its tokens with two line
    breaks; after each block one more is spent that the check doesn't see. If not even the first
    one fits, it is truncated and stands alone.
    """
    rows = used_budget(results.withColumn("block", context_block()).withColumn("cost", block_cost()))
    fits = rows.where(F.col("used") <= max_tokens).select("query_id", "rank", "id", "block", "used", "metadata", "content")
    first = rows.where((F.col("rank") == 1) & (F.col("used") > max_tokens)).select("query_id", "rank", "id", truncated(F.col("block"), max_tokens).alias("block"), "used", "metadata", "content")
    return fits.unionByName(first)


def context_texts(packed: DataFrame) -> DataFrame:
    """One context a query: its blocks, numbered and parted by blank lines."""
    part = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("block")).alias("b"))
    return packed.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.count("*").cast("int").alias("blocks")).select("query_id", "blocks", F.array_join(F.col("p.b"), "\n\n").alias("context"))


def citation(m: str = "metadata") -> Column:
    """The printed citation of a chunk's source."""
    section = F.when(F.coalesce(F.col(f"{m}.section"), F.lit("")) != "", F.concat(F.lit("📂 §"), F.col(f"{m}.section")))
    return F.concat_ws(" | ", F.concat(F.lit("📄 "), F.col(f"{m}.source_file")), F.concat(F.lit("📍 第"), F.col(f"{m}.page_num").cast("string"), F.lit("页")), section)


def citation_rows(packed: DataFrame) -> DataFrame:
    """``query_id``, ``idx``, and of every packed result with metadata its source and the whole content."""
    m = lambda c: F.col(f"metadata.{c}").alias(c)
    return packed.where("metadata is not null").select("query_id", F.col("rank").alias("idx"), m("source_file"), m("page_num"), m("section"), m("chunk_type"), F.col("content").alias("text"))


def query_confidence(results: DataFrame, weight_score: float = 0.6, weight_count: float = 0.4) -> DataFrame:
    """``query_id``, ``confidence``: of the best score and of how many of ten results there are."""
    return results.groupBy("query_id").agg(F.round(weight_score * F.max("score") + weight_count * F.least(F.count("*") / 10, F.lit(1.0)), 4).alias("confidence"))


def decision(confidence: Column, accept: float = 0.75, reject: float = 0.40) -> Column:
    """accept, review or reject; the first threshold must lie above the second."""
    if accept <= reject:
        raise ValueError("the threshold to accept must lie above the one to reject")
    return F.when(confidence >= accept, "accept").when(confidence >= reject, "review").otherwise("reject")


def routed(df: DataFrame, payload: list[str], column: str = "decision") -> DataFrame:
    """Rejected rows lose their payload, reviewed ones are marked; any other decision is an error."""
    known = F.col(column).isin("accept", "review", "reject")
    checked = df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), F.coalesce(F.col(column), F.lit("null"))))))
    kept = {c: F.when(F.col(column) != "reject", F.col(c)) for c in payload}
    return checked.withColumns(kept).withColumn("needs_review", F.col(column) == "review")


def with_cache(rows: DataFrame, cache: DataFrame, key: str, now: Column, valid: Column | None = None) -> DataFrame:
    """``rows`` with ``value`` of the unexpired cache entry of their key, and ``hit``; invalid values are misses."""
    good = cache.where(F.col("expires_at") > now)
    good = good if valid is None else good.where(valid)
    return rows.join(good.select(F.col("key").alias(key), "value"), key, "left").withColumn("hit", F.col("value").isNotNull())


def top_results(results: DataFrame, k: int) -> DataFrame:
    return ranked(results.drop("rank"), k)
