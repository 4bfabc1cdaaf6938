"""The queries of the engine and the SQL they are held against.

Each query runs over its whole tables. The corpus of keyword search is the documents' texts, asked
with the evaluation items; hybrid search asks the chunks with the section and vector of every chunk
whose id's last hexadecimal digits are divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, confidence, index, layout, retrieval, review, scorers
from .operators import tables as tab
from .session import keep, on_its_own, once
from .sources import documents as src
from .sources import stores
from .sources.tables import table
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = on_its_own(f)
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


SP = T.SPACE
TOK = f"flatten(list_transform(list_filter(regexp_split_to_array(lower(%s), '{SP}+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '{T.HAN}') THEN list_filter(string_split(w, ''), lambda c: c <> '') ELSE [w] END))"
STRIP = f"regexp_replace(regexp_replace(%s, '^{SP}+', ''), '{SP}+$', '')"
ASKED = "CAST('0x' || right(chunk_id, 4) AS INTEGER) % 100 = 0"
FIRST_BLOCKS = "b AS (SELECT DISTINCT ON (block_id) * FROM blocks WHERE block_id IS NOT NULL ORDER BY block_id, content)"


def _asked(c: str = "chunk_id", every: int = 100):
    return F.conv(F.right(F.col(c), F.lit(4)), 16, 10).cast("int") % every == 0


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "lang", "source")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The distinct chunks; of several rows of an id the one with the smallest content."""
    return _one_each(table(spark, d, "chunks"))


def _one_each(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("chunk_id is not null")
    return rows.groupBy("chunk_id").agg(F.min_by(F.struct(*rows.columns), F.struct(F.coalesce("content", F.lit("")), F.col("metadata").isNull())).alias("r")).select("r.*")


CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, coalesce(content, ''), metadata IS NULL)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The distinct blocks."""
    rows = table(spark, d, "blocks").where("block_id is not null")
    return rows.groupBy("block_id").agg(F.min_by(F.struct(*rows.columns), F.coalesce("content", F.lit(""))).alias("r")).select("r.*")


BLOCKS = "b AS (SELECT DISTINCT ON (block_id) * FROM blocks WHERE block_id IS NOT NULL ORDER BY block_id, coalesce(content, ''))"

# indexes

POSTINGS = f"""
t AS (SELECT doc_id AS id, unnest({TOK % "text"}) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id AS id, len({TOK % "text"}) AS dl FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
r AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM r, s),
i AS (SELECT term, df, greatest(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM w) ELSE raw END, 0.1::DOUBLE) AS idf FROM w)"""


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    p = index.keyword_postings(_docs(spark, d), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return index.weighed(index.keyword_postings(docs, "doc_id", "text"), docs.agg(F.count("text").alias("n"))).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25_sql(allowed: str = "") -> str:
    return f"""WITH {POSTINGS},
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOK % "text"}) AS term FROM eval_items) GROUP BY ALL),
x AS (SELECT query_id, p.id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM q JOIN i USING (term) JOIN p USING (term) JOIN l ON l.id = p.id, s {allowed} GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""


@query(_bm25_sql())
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return index.keyword_search(index.keyword_index(_docs(spark, d), "doc_id", "text"), _items(spark, d))


@query(_bm25_sql("WHERE p.id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def bm25_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    allowed = _docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return index.keyword_search(index.keyword_index(_docs(spark, d), "doc_id", "text"), _items(spark, d), allowed=allowed)


UNITS = """
u0 AS (SELECT DISTINCT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL),
u1 AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u0),
u AS (SELECT id, list_transform(v, lambda x: x / norm) AS v FROM u1 WHERE norm > 0)"""


def _vector_sql(where: str = "") -> str:
    return f"""WITH {UNITS},
x AS (SELECT q.id AS query_id, u.id, round(list_dot_product(q.v, u.v), 6) AS score FROM u AS q, u WHERE CAST('0x' || right(q.id, 4) AS INTEGER) % 100 = 0 AND len(q.v) = len(u.v) {where})
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return once(("units", d), lambda: index.unit_vectors(table(spark, d, "vectors", "chunk_id", "embedding"), "chunk_id", "embedding"), kept=False)


@query(_vector_sql())
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    return index.vector_search(u, u.where(_asked("id")).withColumnRenamed("id", "query_id"))


@query(_vector_sql("AND u.id IN (SELECT chunk_id FROM vectors WHERE source_file LIKE '%.pdf')"))
def vector_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    allowed = table(spark, d, "vectors", "chunk_id", "source_file").where("source_file like '%.pdf'").select(F.col("chunk_id").alias("id")).distinct()
    return index.vector_search(u.join(allowed, "id", "left_semi"), u.where(_asked("id")).withColumnRenamed("id", "query_id"))


def _kept_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The distinct chunks with what retrieval needs of their metadata; read where they lie, but for repeated ones."""
    source = F.struct(*[F.col(f"metadata.{c}").alias(c) for c in ("source_file", "page_num", "section", "chunk_type")])
    narrow = lambda: table(spark, d, "chunks", "chunk_id", "content", F.when(F.col("metadata").isNotNull(), source).alias("metadata"))
    return once(("chunks", d), lambda: index.distinct_by(narrow().where("chunk_id is not null"), "chunk_id", _one_each), kept=False)


def _hybrid_queries(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    rows = lambda: _kept_chunks(spark, d).where(_asked(every=every)).select(F.col("chunk_id").alias("query_id"), F.coalesce("metadata.section", F.lit("")).alias("query"))
    return once(("queries", d, every), rows)


def _rankings(spark: SparkSession, d: str, every: int) -> tuple[DataFrame, DataFrame]:
    queries, u = _hybrid_queries(spark, d, every), _units(spark, d)
    words = index.keyword_search(index.keyword_index(_kept_chunks(spark, d), "chunk_id", "content", unique=True), queries, 30)
    return index.vector_search(u, u.where(_asked("id", every)).withColumnRenamed("id", "query_id"), 30), words


def _hybrid(spark: SparkSession, d: str, k: int = 10, every: int = 100) -> DataFrame:
    return once(("hybrid", d, k, every), lambda: index.fused(*_rankings(spark, d, every), k))


HYBRID = f"""{CHUNKS},
t AS (SELECT chunk_id AS id, unnest({TOK % "content"}) AS term FROM c WHERE content IS NOT NULL),
p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT chunk_id AS id, len({TOK % "content"}) AS dl FROM c WHERE content IS NOT NULL),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
r AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM r, s),
i AS (SELECT term, df, greatest(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM w) ELSE raw END, 0.1::DOUBLE) AS idf FROM w),
q AS (SELECT chunk_id AS query_id, coalesce(metadata.section, '') AS query FROM c WHERE {ASKED}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOK % "query"}) AS term FROM q) GROUP BY ALL),
k0 AS (SELECT query_id, p.id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM qt JOIN i USING (term) JOIN p USING (term) JOIN l ON l.id = p.id, s GROUP BY ALL),
k AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k0 WHERE score > 0) WHERE rank <= 30),
{UNITS},
v0 AS (SELECT q.id AS query_id, u.id, round(list_dot_product(q.v, u.v), 6) AS score FROM u AS q, u WHERE CAST('0x' || right(q.id, 4) AS INTEGER) % 100 = 0 AND len(q.v) = len(u.v)),
v AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v0) WHERE rank <= 30),
f AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 6) AS score FROM v FULL JOIN k USING (query_id, id)),
h AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10)"""


@query(f"WITH {HYBRID} SELECT * FROM h")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "id", "score", "rank")


# retrieval


def _candidates(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """The fused results with content and metadata."""
    c = _kept_chunks(spark, d).select(F.col("chunk_id").alias("id"), "content", "metadata")
    return once(("candidates", d, every), lambda: retrieval.with_contents(_hybrid(spark, d, every=every).select("query_id", "id", "score", "rank"), c), kept=False)


TERMS = f"""dw AS (SELECT h.query_id, unnest(regexp_split_to_array(c.content, '{SP}+')) AS term FROM h JOIN c ON c.chunk_id = h.id WHERE h.rank <= 5),
dt AS (SELECT dw.query_id, term, count(*) AS n FROM dw JOIN q USING (query_id) WHERE length(term) >= 2 AND NOT contains(query, term) AND term NOT IN ({", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)}) GROUP BY ALL),
dr AS (SELECT * FROM (SELECT query_id, term, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, length(term) DESC, term) AS rank FROM dt) WHERE rank <= 10)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.domain_terms(_candidates(spark, d).where("rank <= 5"), _hybrid_queries(spark, d))


@query(f"WITH {HYBRID}, {TERMS} SELECT * FROM dr")
def domain_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


@query(f"WITH {HYBRID}, {TERMS} SELECT q.query_id, CASE WHEN count(term) >= 3 THEN q.query || ' ' || string_agg(term, ' ' ORDER BY rank) ELSE q.query END AS rerank_query FROM q LEFT JOIN dr USING (query_id) GROUP BY q.query_id, q.query")
def rerank_query(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.expanded_queries(_hybrid_queries(spark, d), _terms(spark, d))


RERANK = f"""rw AS (SELECT h.query_id, h.id, h.rank AS before, c.content, c.metadata, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '{SP}+'), lambda w: w <> '')) AS ws FROM h JOIN c ON c.chunk_id = h.id JOIN q USING (query_id)),
rs AS (SELECT query_id, id, before, content, metadata, round(1 / (1 + exp(-(4 * (len(list_filter(ws, lambda w: contains(lower(content), w)))::DOUBLE / greatest(len(ws), 1)) - 2))), 6) AS score FROM rw),
rr AS (SELECT query_id, id, score, content, metadata, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM rs)"""


def _reranked(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    return once(("reranked", d, every), lambda: retrieval.reranked(_candidates(spark, d, every).drop("score"), _hybrid_queries(spark, d, every)))


@query(f"WITH {HYBRID}, {RERANK} SELECT query_id, id, score, rank FROM rr")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "id", "score", "rank")


HEAD = "'[来源: ' || coalesce(metadata.source_file, '') || ' | 第' || coalesce(CAST(metadata.page_num AS VARCHAR), '0') || '页' || CASE WHEN coalesce(metadata.section, '') <> '' THEN ' | §' || metadata.section ELSE '' END || ' | 类型: ' || coalesce(metadata.chunk_type, 'text') || ']'"
BLOCK = f"CASE WHEN metadata IS NULL THEN content ELSE concat_ws(chr(10), {HEAD}, content, {HEAD}) END"


@query(f"WITH {CHUNKS} SELECT chunk_id, {BLOCK} AS block, CAST(length(content) // 2 AS INTEGER) AS tokens FROM c")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", retrieval.context_block().alias("block"), T.token_estimate(F.col("content")).alias("tokens"))


def _last(mark: str) -> str:
    m = "chr(10)" if mark == "\n" else f"'{mark}'"
    return f"CASE WHEN contains(h, {m}) AND length(h) - strpos(reverse(h), {m}) > 400 THEN length(h) - strpos(reverse(h), {m}) END"


@query(f"""WITH {CHUNKS}, x AS (SELECT chunk_id, content, substr(content, 1, 800) AS h FROM c),
y AS (SELECT chunk_id, content, h, coalesce({", ".join(map(_last, retrieval.ENDS))}) AS pos FROM x)
SELECT chunk_id, CASE WHEN length(content) <= 800 THEN content ELSE coalesce(substr(h, 1, pos + 1), h) || chr(10) || '[内容过长，已截断]' END AS cut FROM y""")
def context_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", retrieval.truncated(F.col("content"), 400).alias("cut"))


PACK = f"""pk0 AS (SELECT query_id, rank, id, {BLOCK} AS block, metadata FROM rr),
pk1 AS (SELECT *, sum((length(block) + 2) // 2) OVER (PARTITION BY query_id ORDER BY rank) + greatest(rank - 2, 0) AS used FROM pk0),
pk AS (SELECT query_id, rank, id, block, CAST(used AS BIGINT) AS used FROM pk1 WHERE used <= 3600)"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.packed_context(_reranked(spark, d))


@query(f"WITH {HYBRID}, {RERANK}, {PACK} SELECT query_id, rank, id, used FROM pk UNION ALL SELECT query_id, rank, id, CAST(used AS BIGINT) FROM pk1 WHERE rank = 1 AND used > 3600")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The packed results by number. Of contents only scores and costs are needed, which are told where they lie: no content is shuffled or kept."""
    asked = _hybrid_queries(spark, d).select("query_id", F.col("query").alias("q"))
    asking = _hybrid(spark, d).where(F.col("rank") <= retrieval.RERANK_POOL).select("query_id", "id", "rank").join(asked, "query_id")
    found = retrieval.with_contents(asking, _kept_chunks(spark, d).select(F.col("chunk_id").alias("id"), "content", "metadata"))
    costed = keep(retrieval.rescored(found).select("query_id", "id", "before", "score", retrieval.block_cost().alias("cost")))
    return retrieval.packed_costs(retrieval.reordered(costed)).select("query_id", "rank", "id", F.col("used").cast("bigint").alias("used"))


@query(f"WITH {HYBRID}, {RERANK}, {PACK} SELECT query_id, CAST(count(*) AS INTEGER) AS blocks, string_agg('[' || rank || '] ' || block, chr(10) || chr(10) ORDER BY rank) AS context FROM pk GROUP BY query_id")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.context_texts(_packed(spark, d).where("used <= 3600"))


@query(f"WITH {CHUNKS} SELECT chunk_id, concat_ws(' | ', '📄 ' || metadata.source_file, '📍 第' || metadata.page_num || '页', CASE WHEN coalesce(metadata.section, '') <> '' THEN '📂 §' || metadata.section END) AS citation FROM c WHERE metadata IS NOT NULL")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("metadata is not null").select("chunk_id", retrieval.citation().alias("citation"))


@query(f"WITH {HYBRID}, {RERANK}, {PACK} SELECT pk0.query_id, pk0.rank AS idx, rr.metadata.source_file AS source_file, rr.metadata.page_num AS page_num, rr.metadata.section AS section, rr.metadata.chunk_type AS chunk_type, rr.content AS text FROM pk0 JOIN rr USING (query_id, rank) JOIN pk1 USING (query_id, rank) WHERE rr.metadata IS NOT NULL AND (pk1.used <= 3600 OR pk0.rank = 1)")
def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row per cited result, with the whole content."""
    return retrieval.citation_rows(_packed(spark, d))


CONF = "cf AS (SELECT query_id, round(0.6::DOUBLE * max(score) + 0.4::DOUBLE * least(count(*) / 10.0::DOUBLE, 1), 4) AS confidence FROM rr GROUP BY query_id)"


@query(f"WITH {HYBRID}, {RERANK}, {CONF} SELECT query_id, confidence, CASE WHEN confidence >= 0.75 THEN 'accept' WHEN confidence >= 0.4 THEN 'review' ELSE 'reject' END AS decision FROM cf")
def query_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.query_confidence(_reranked(spark, d))
    return c.withColumn("decision", retrieval.decision(F.col("confidence")))


RESPONSE = f"""WITH {HYBRID}, {RERANK}, {CONF},
best AS (SELECT query_id, id, content FROM rr WHERE rank = 1)
SELECT q.query_id, coalesce(confidence, 0) AS confidence, CASE WHEN coalesce(confidence, 0) >= 0.75 THEN 'accept' WHEN coalesce(confidence, 0) >= 0.4 THEN 'review' ELSE 'reject' END AS decision,
CASE WHEN confidence IS NULL THEN 'nothing found' WHEN confidence < 0.4 THEN 'low confidence' ELSE substr(content, 1, 200) END AS answer,
CASE WHEN confidence >= 0.4 THEN id END AS source_id, coalesce(confidence >= 0.4 AND confidence < 0.75, false) AS needs_review
FROM q LEFT JOIN cf USING (query_id) LEFT JOIN best USING (query_id)"""


@query(RESPONSE)
def query_response(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """Batch hybrid retrieval to the answer: the best chunk's beginning as an extract, its source, confidence and route."""
    results = _reranked(spark, d, every)
    best = results.where("rank = 1").select("query_id", F.col("id").alias("source_id"), F.substring("content", 1, 200).alias("answer"))
    out = _hybrid_queries(spark, d, every).select("query_id").join(retrieval.query_confidence(results), "query_id", "left").join(best, "query_id", "left")
    nothing = F.col("confidence").isNull()
    out = out.withColumn("nothing", nothing).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("decision", retrieval.decision(F.col("confidence")))
    out = retrieval.routed(out, ["answer", "source_id"])
    answer = F.when(F.col("nothing"), "nothing found").when(F.col("decision") == "reject", "low confidence").otherwise(F.col("answer"))
    return out.select("query_id", "confidence", "decision", answer.alias("answer"), "source_id", "needs_review")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The answers to all chunks' sections."""
    return query_response(spark, folder, 1)


@query(f"WITH {HYBRID}, {RERANK}, ok AS (SELECT q.query_id, coalesce(bool_or(contains(lower(content), lower(query))), false) AND count(rr.id) >= 1 AS passed, count(rr.id) AS cites FROM q LEFT JOIN rr USING (query_id) GROUP BY q.query_id) SELECT count(*) AS asked, CAST(coalesce(count_if(passed), 0) AS BIGINT) AS passed, round(avg(cites), 6) AS avg_citations FROM ok")
def eval_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    """Queries one of whose results holds the asked section's name, and has a citation."""
    q = _hybrid_queries(spark, d)
    r = _reranked(spark, d).select("query_id", "id", "content")
    hit = F.coalesce(F.bool_or(F.contains(F.lower("content"), F.lower("query"))), F.lit(False)) & (F.count("id") >= 1)
    per = q.join(r, "query_id", "left").groupBy("query_id").agg(hit.alias("passed"), F.count("id").alias("cites"))
    return per.agg(F.count("*").alias("asked"), F.count_if("passed").alias("passed"), F.round(F.avg("cites"), 6).alias("avg_citations"))


# sinks and caches


@query("SELECT chunk_id, coalesce(content, '')[1:1000] AS payload, coalesce(metadata.source_file, '') AS source_file, coalesce(metadata.page_num, 0) AS page_num, coalesce(metadata.chunk_type, 'text') AS chunk_type FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, coalesce(content, ''), metadata IS NULL) SEMI JOIN (SELECT chunk_id FROM vectors WHERE embedding IS NOT NULL) USING (chunk_id)")
def index_payload(spark: SparkSession, d: str) -> DataFrame:
    """What the vector index keeps of each chunk that has a vector."""
    c = _chunks(spark, d).join(table(spark, d, "vectors", "chunk_id", "embedding").where("embedding is not null").select("chunk_id").distinct(), "chunk_id", "left_semi")
    return c.select("chunk_id", F.substring(F.coalesce("content", F.lit("")), 1, 1000).alias("payload"), F.coalesce("metadata.source_file", F.lit("")).alias("source_file"), F.coalesce("metadata.page_num", F.lit(0)).alias("page_num"), F.coalesce("metadata.chunk_type", F.lit("text")).alias("chunk_type"))


@query(f"WITH {CHUNKS}, m AS (SELECT min(metadata.source_file) AS f FROM c) SELECT chunk_id, metadata.source_file AS source_file FROM c, m WHERE metadata.source_file IS NULL OR metadata.source_file <> f")
def delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The chunks after those of one source, the first by name, are deleted."""
    c = _kept_chunks(spark, d).select("chunk_id", F.col("metadata.source_file").alias("source_file"))
    first = c.agg(F.min("source_file").alias("gone"))
    return index.without_source(c.crossJoin(F.broadcast(first)), "source_file", F.col("gone")).select("chunk_id", "source_file")  # one row


@query(f"WITH {CHUNKS}, m AS (SELECT min(metadata.source_file) AS f FROM c) SELECT CAST(count_if(metadata.source_file IS NOT NULL AND metadata.source_file = f) AS BIGINT) AS removed, CAST(count_if(metadata.source_file IS NULL OR metadata.source_file <> f) AS BIGINT) AS kept FROM c, m")
def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _kept_chunks(spark, d).select(F.col("metadata.source_file").alias("source_file"))
    first = c.agg(F.min("source_file").alias("gone"))
    return index.removed_count(c.crossJoin(F.broadcast(first)), "source_file", F.col("gone"))  # one row


@query("SELECT count(DISTINCT chunk_id) AS rows FROM vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL")
def vector_count(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors", "chunk_id", "embedding").where("embedding is not null and chunk_id is not null")
    return index.collection_size(v.select("chunk_id").distinct())


@query("SELECT chunk_id, CASE WHEN bool_or(source_file LIKE '%.pdf') THEN 'again/' || min(source_file) FILTER (WHERE source_file LIKE '%.pdf') ELSE min(source_file) END AS source_file FROM vectors WHERE source_file IS NOT NULL AND embedding IS NOT NULL GROUP BY chunk_id")
def upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The index after the vectors of PDF files are delivered once more from another folder: their rows are replaced, the others stay."""
    v = table(spark, d, "vectors").where("source_file is not null and embedding is not null").groupBy("chunk_id")
    held = keep(v.agg(F.min("source_file").alias("source_file"), F.min(F.when(F.col("source_file").like("%.pdf"), F.col("source_file"))).alias("pdf")))
    new = held.where("pdf is not null").select("chunk_id", F.concat(F.lit("again/"), "pdf").alias("source_file"))
    return index.upserted(held.select("chunk_id", "source_file"), new, "chunk_id")


@query("SELECT DISTINCT sha256(text)[1:16] AS content_key, md5(source || '|' || lang)[1:12] AS source_key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null and source is not null and lang is not null")
    return rows.select(T.content_key(F.col("text")).alias("content_key"), T.pair_key(F.col("source"), F.col("lang")).alias("source_key")).distinct()


@query("SELECT DISTINCT sha256(c.content)[1:16] AS key FROM chunks c WHERE content IS NOT NULL AND sha256(c.content)[1:16] NOT IN (SELECT sha256(c2.content)[1:16] FROM chunks c2 JOIN vectors v USING (chunk_id) WHERE c2.content IS NOT NULL AND len(v.embedding) = 64)")
def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Contents to encode: those whose key has no cached vector of the right length, each once."""
    c = table(spark, d, "chunks", "chunk_id", "content").where("content is not null").withColumn("key", T.content_key(F.col("content")))
    good = table(spark, d, "vectors", "chunk_id", "embedding").where("size(embedding) = 64").select("chunk_id").distinct()
    cache = c.join(good, "chunk_id", "left_semi").select("key", F.lit("v").alias("value"), (F.current_timestamp() + F.expr("interval 7 days")).alias("expires_at")).distinct()
    return retrieval.with_cache(c.select("key").distinct(), cache, "key", F.current_timestamp()).where("not hit").select("key")


# sources and layout


@query("SELECT doc_id, page_num, CAST(greatest(1, length(text) // 3000) AS INTEGER) AS estimated, regexp_matches(text, '[∑∫∂√π∞Δλ→≈∈⊂]') AS formula FROM (SELECT DISTINCT doc_id, page_num, text FROM pages WHERE text IS NOT NULL)")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages", "doc_id", "page_num", "text").where("text is not null").distinct()
    return p.select("doc_id", "page_num", T.estimated_pages(F.length("text")).alias("estimated"), T.formula_flag(F.col("text")).alias("formula"))


@query(f"WITH {BLOCKS} SELECT doc_id, page_num, string_agg(content || chr(10), '' ORDER BY block_idx, content) AS text FROM b WHERE content IS NOT NULL GROUP BY ALL")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return src.page_texts(_blocks(spark, d).where("content is not null"))


@query(f"SELECT DISTINCT doc_id, filename, CASE WHEN lower(regexp_extract(filename, '\\.([^.]+)$', 1)) = 'pdf' THEN 'pdf' ELSE 'docx' END AS loader FROM parsed_documents WHERE filename IS NOT NULL")
def loaders(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_documents", "doc_id", "filename").where("filename is not null").distinct()
    return p.select("doc_id", "filename", src.loader(F.col("filename")).alias("loader"))


_STYLE = """CASE WHEN metadata.style IN ('Heading 1', 'Title', '1') THEN 'title' WHEN metadata.style IN ('Heading 2', 'Heading 3', 'Heading 4', 'Heading 5', 'Heading 6', 'Subtitle', '2', '3') THEN 'section_heading'
WHEN metadata.max_font_size >= 18 THEN 'title' WHEN metadata.max_font_size >= 14 THEN 'section_heading'
WHEN length(content) <= 60 AND regexp_matches(content, '^(第[一二三四五六七八九十百\\d]+[章节]|\\d+(\\.\\d+)+|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\\d]+[）)]|.{1,8}题$)') THEN 'section_heading' ELSE 'text' END"""


@query(f"WITH {BLOCKS} SELECT block_id, {_STYLE} AS kind FROM b WHERE content IS NOT NULL")
def styled_types(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("content is not null").select("block_id", layout.styled_type(F.col("metadata.style"), F.col("metadata.max_font_size"), F.col("content")).alias("kind"))


_TRIM = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"WITH {BLOCKS} SELECT block_id, CASE WHEN lower({_TRIM}) LIKE 'table %' OR {_TRIM} LIKE '表 %' THEN 'table_caption' WHEN lower({_TRIM}) LIKE 'figure %' OR {_TRIM} LIKE '图 %' THEN 'figure_caption' WHEN metadata.max_font_size >= 18 THEN 'title' WHEN metadata.max_font_size >= 12 THEN 'section_heading' ELSE 'text' END AS class FROM b WHERE content IS NOT NULL")
def block_classes(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("content is not null").select("block_id", layout.block_class(F.col("metadata.max_font_size"), F.col("content")).alias("class"))


_CLASSED = [
    ("Table 2: Results", 10.0), ("表 1：实验数据", 10.0), ("  Table 1 x", 20.0), ("\n图 3 结构", 11.0), ("FIGURE 4", 30.0), ("Tables", 10.0), ("Report", 18.0), ("Report", 24.0), ("Part", 14.0), ("Part", 12.0), ("Body", 11.9), ("", 18.0), ("Body", None),
]


@query("""SELECT * FROM (VALUES (0, 'table_caption'), (1, 'table_caption'), (2, 'table_caption'), (3, 'figure_caption'), (4, 'figure_caption'), (5, 'text'), (6, 'title'), (7, 'title'), (8, 'section_heading'),
(9, 'section_heading'), (10, 'text'), (11, 'title'), (12, 'text')) AS t(n, class)""")
def block_class_cases(spark: SparkSession, d: str) -> DataFrame:
    """The class of single texts: captions before sizes, blanks at the ends ignored."""
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(_CLASSED)], "n int, text string, size double")
    return rows.select("n", layout.block_class(F.col("size"), F.col("text")).alias("class"))


@query("""SELECT * FROM (VALUES ('doc_title', 'title'), ('paragraph_title', 'section_heading'), ('image', 'figure'), ('chart', 'figure'), ('seal', 'figure'), ('figure_title', 'figure_caption'), ('table', 'table'), ('header', 'header'),
('header_image', 'header'), ('footer', 'footer'), ('footer_image', 'footer'), ('footnote', 'footer'), ('vision_footnote', 'footer'), ('display_formula', 'formula'), ('inline_formula', 'formula'), ('formula_number', 'formula'),
('reference', 'reference'), ('reference_content', 'reference'), ('text', 'text'), ('abstract', 'text'), ('algorithm', 'text'), ('number', 'text'), ('unknown', 'text')) AS t(label, category)""")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in (*layout.CATEGORIES, "text", "abstract", "algorithm", "number", "unknown")], "label string")
    return labels.select("label", layout.category(F.col("label")).alias("category"))


@query(f"WITH {BLOCKS} SELECT block_id, CASE coalesce(block_type, 'text') WHEN 'heading' THEN 'section_heading' WHEN 'image' THEN 'figure' WHEN 'unknown' THEN 'text' ELSE coalesce(block_type, 'text') END AS category, round(coalesce(nullif(confidence, 0), 0.85), 6) AS confidence, content[1:200] AS text FROM b")
def block_elements(spark: SparkSession, d: str) -> DataFrame:
    return layout.layout_elements(_blocks(spark, d)).select("block_id", "category", F.round("confidence", 6).alias("confidence"), "text")


PAGED = """pw AS (SELECT doc_id, page_num, max(width) AS w FROM pages GROUP BY ALL),
bw AS (SELECT b.*, coalesce(w, 595.0) AS w, coalesce(block_type IN ('figure', 'image'), false) AS image FROM b LEFT JOIN pw USING (doc_id, page_num)),
sd AS (SELECT doc_id, page_num, count_if(NOT image AND bbox.x1 <= w / 2 - 0.08 * w) AS l, count_if(NOT image AND NOT bbox.x1 <= w / 2 - 0.08 * w AND bbox.x0 >= w / 2 + 0.08 * w) AS r FROM bw GROUP BY ALL),
tc AS (SELECT doc_id, page_num, coalesce(l + r >= 3 AND l / nullif(l + r, 0) >= 0.25 AND r / nullif(l + r, 0) >= 0.25, false) AS two_columns FROM sd)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    widths = table(spark, d, "pages", "doc_id", "page_num", "width").groupBy("doc_id", "page_num").agg(F.max("width").alias("width"))
    return _blocks(spark, d).join(widths, ["doc_id", "page_num"], "left").withColumn("image", F.coalesce(F.col("block_type").isin("figure", "image"), F.lit(False)))


@query(f"WITH {BLOCKS}, {PAGED} SELECT * FROM tc")
def two_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.two_columns(_boxes(spark, d))


@query(f"""WITH {BLOCKS}, {PAGED} SELECT block_id, CAST(row_number() OVER (PARTITION BY doc_id, page_num
ORDER BY bbox.y0, CASE WHEN two_columns AND NOT image AND NOT bbox.x1 < w / 2 - 0.08 * w AND bbox.x0 > w / 2 + 0.08 * w THEN 1 ELSE 0 END, block_idx, block_id) - 1 AS INTEGER) AS "order" FROM bw JOIN tc USING (doc_id, page_num) WHERE bbox IS NOT NULL""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, d)).select("block_id", "order")


def _raw_pages(spark: SparkSession) -> DataFrame:
    """Pages in dictionary form: one with two columns among wide lines and a picture, one of one column, one of width 0, one empty."""
    text = lambda x0, y0, x1, t, size=11.0: {"type": 0, "bbox": [x0, y0, x1, y0 + 10], "lines": [{"spans": [{"text": t, "size": size, "font": "f"}]}]}
    wide = [text(50.0, 300.0 + k, 550.0, f"wide {k}") for k in range(6)]
    picture = {"type": 1, "bbox": [400.0, 100.0, 500.0, 150.0], "lines": None}
    both = [text(400.0, 100.0, 550.0, "right one"), text(50.0, 100.0, 200.0, " left one "), text(400.0, 200.0, 550.0, "right two"), text(50.0, 200.0, 200.0, "left two"), text(340.0, 200.0, 550.0, "in the gap"), picture, *wide]
    blank = {"type": 0, "bbox": [0.0, 0.0, 1.0, 1.0], "lines": [{"spans": [{"text": "  ", "size": 30.0, "font": "f"}]}, {"spans": []}]}
    parts = {"type": 0, "bbox": [10.0, 5.0, 90.0, 9.0], "lines": [{"spans": [{"text": "Big", "size": 18.0, "font": "f"}, {"text": " small", "size": 8.0, "font": "f"}]}, {"spans": [{"text": "x", "size": None, "font": "f"}]}]}
    one = [text(10.0, 50.0, 90.0, "  Table 1 x", 20.0), blank, parts, text(10.0, 30.0, 90.0, "Head", 14.0)]
    rows = [("a", 1, 595.0, 842.0, both), ("a", 2, 600.0, 800.0, one), ("b", 1, 0.0, 0.0, [text(1.0, 2.0, 3.0, "y"), text(1.0, 1.0, 3.0, "z")]), ("b", 2, 595.0, 842.0, [])]
    return spark.createDataFrame(rows, src.TEXT_DICT)


RAW_ELEMENTS = """SELECT * FROM (VALUES ('a', 1, 0, 'text', 0.85, 'left one'), ('a', 1, 1, 'figure', 0.9, ''), ('a', 1, 2, 'text', 0.85, 'right one'), ('a', 1, 3, 'text', 0.85, 'left two'), ('a', 1, 4, 'text', 0.85, 'in the gap'),
('a', 1, 5, 'text', 0.85, 'right two'), ('a', 1, 6, 'text', 0.85, 'wide 0'), ('a', 1, 7, 'text', 0.85, 'wide 1'), ('a', 1, 8, 'text', 0.85, 'wide 2'), ('a', 1, 9, 'text', 0.85, 'wide 3'), ('a', 1, 10, 'text', 0.85, 'wide 4'),
('a', 1, 11, 'text', 0.85, 'wide 5'), ('a', 2, 0, 'title', 0.85, 'Big smallx'), ('a', 2, 1, 'section_heading', 0.85, 'Head'), ('a', 2, 2, 'table_caption', 0.85, 'Table 1 x'), ('b', 1, 0, 'text', 0.85, 'z'), ('b', 1, 1, 'text', 0.85, 'y')
) AS t(doc_id, page_num, element_idx, category, confidence, text)"""


@query(RAW_ELEMENTS.replace("0.85", "0.85::DOUBLE").replace("0.9,", "0.9::DOUBLE,"))
def raw_elements(spark: SparkSession, d: str) -> DataFrame:
    """Layout without a model, from pages in dictionary form."""
    return layout.raw_elements(_raw_pages(spark)).drop("bbox")


@query("SELECT * FROM (VALUES ('a', 1, true), ('a', 2, false), ('b', 1, false), ('b', 2, false)) AS t(doc_id, page_num, two_columns)")
def two_column_cases(spark: SparkSession, d: str) -> DataFrame:
    """Two columns on pages of few texts: wide ones and pictures don't count."""
    rows = _raw_pages(spark).select("doc_id", "page_num", "width", F.explode_outer("blocks").alias("b"))
    box = F.struct(*[F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return layout.two_columns(rows.select("doc_id", "page_num", "width", F.when(F.col("b").isNotNull(), box).alias("bbox"), (F.coalesce("b.type", F.lit(0)) == 1).alias("image")))


@query(f"""WITH r AS ({RAW_ELEMENTS}) SELECT doc_id, page_num, 'raw' AS source, count(*) AS n FROM r WHERE NOT (doc_id = 'a' AND page_num = 2) GROUP BY ALL UNION ALL SELECT 'a', 2, 'model', 1 UNION ALL SELECT 'w', 1, 'word', 1""")
def layout_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each page's elements from the first source that has any: a model for one page, text dictionaries, word-processor blocks."""
    raw = layout.raw_elements(_raw_pages(spark))
    one = lambda doc, page: raw.where("doc_id = 'b' and element_idx = 0").select(F.lit(doc).alias("doc_id"), F.lit(page).alias("page_num"), *raw.columns[2:])
    out = layout.analysed(one("a", 2), raw, one("w", 1).unionByName(one("a", 2)))
    return out.groupBy("doc_id", "page_num", "source").agg(F.count("*").alias("n"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", (F.col("page_num").cast("bigint") * 1000000 + F.col("block_idx")).alias("element_idx"), F.col("block_type").alias("category"), F.col("content").alias("text"))


_HEADS = ", ".join(f"'{h}'" for h in layout.HEADINGS)
TREE = f"""e AS (SELECT doc_id, CAST(page_num AS BIGINT) * 1000000 + block_idx AS element_idx, block_type AS category, content AS text FROM b),
tr AS (SELECT doc_id, element_idx, category, text[1:120] AS text, CASE WHEN NOT coalesce(lower(category) IN ({_HEADS}), false) THEN last_value(CASE WHEN lower(category) IN ({_HEADS}) THEN element_idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY element_idx) END AS parent_idx FROM e)"""


@query(f"WITH {BLOCKS}, {TREE} SELECT doc_id, element_idx, coalesce(parent_idx, -1) AS parent_idx FROM tr")
def layout_tree(spark: SparkSession, d: str) -> DataFrame:
    return layout.layout_tree(_elements(spark, d)).select("doc_id", "element_idx", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx"))


@query(f"WITH {BLOCKS}, {TREE} SELECT doc_id, element_idx, CASE WHEN parent_idx IS NULL THEN '' ELSE '  ' END || '[' || coalesce(category, '') || '] ' || coalesce(text, '')[1:60] AS line FROM tr")
def tree_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.tree_lines(layout.layout_tree(_elements(spark, d)))


@query(f"WITH {BLOCKS}, {TREE} SELECT doc_id, element_idx, '/' || coalesce(category, '') AS path FROM tr")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return layout.tree_paths(layout.layout_tree(_elements(spark, d))).select("doc_id", "element_idx", F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"))


_I = "CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0 END"


@query(f"""WITH {BLOCKS}, o AS (SELECT doc_id, page_num, block_id, bbox, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY block_idx, block_id) AS place FROM b WHERE bbox IS NOT NULL),
pr AS (SELECT p.block_id AS id_a, n.block_id AS id_b, p.bbox AS a, n.bbox AS b FROM o p JOIN o n ON p.doc_id = n.doc_id AND p.page_num = n.page_num AND n.place = p.place + 1),
z AS (SELECT id_a, id_b, {_I} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM pr)
SELECT id_a, id_b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM z""")
def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    return layout.neighbours(_blocks(spark, d)).select("id_a", "id_b", F.round(layout.iou("a", "b"), 6).alias("iou"))


@query(f"""WITH {BLOCKS}, rg AS (SELECT doc_id, page_num, block_id AS region_id, bbox AS r FROM b WHERE block_type IN ('figure', 'table') AND bbox IS NOT NULL),
tx AS (SELECT region_id, sum(length(content)) AS chars FROM rg JOIN b USING (doc_id, page_num) WHERE block_type = 'text' AND bbox IS NOT NULL AND NOT (r.x1 < bbox.x0 OR bbox.x1 < r.x0 OR r.y1 < bbox.y0 OR bbox.y1 < r.y0) GROUP BY region_id)
SELECT region_id, CAST(coalesce(chars, 0) AS BIGINT) AS chars, coalesce(chars, 0) > 30 AS has_text FROM rg LEFT JOIN tx USING (region_id)""")
def region_text(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    regions = b.where("block_type in ('figure', 'table') and bbox is not null").select("doc_id", "page_num", F.col("block_id").alias("region_id"), F.col("bbox").alias("region"))
    return layout.has_text(regions, b)


@query(f"WITH {BLOCKS} SELECT block_id, round(least(0.95, 0.5 + length(content) / 2000.0), 6) AS page_confidence FROM b WHERE metadata.source IS NOT NULL AND metadata.source <> 'textbox' AND content IS NOT NULL")
def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("metadata.source is not null and metadata.source <> 'textbox' and content is not null")
    return b.select("block_id", F.round(layout.page_confidence(F.col("content")), 6).alias("page_confidence"))


_FENCED = ["```latex\nx^2\n```", "```LaTeX\n$$a$$\n```", "``````", "", "  $$x$$ ", "a ```b``` c", "```", "```x", "y\nz\n```", None, "x```"]


@query("""SELECT * FROM (VALUES (0, 'x^2', 0.7::DOUBLE), (1, '$$a$$', 0.85), (2, '', 0.0), (3, '', 0.0), (4, '$$x$$', 0.85), (5, 'a ```b``` c', 0.7), (6, '', 0.0), (7, 'x', 0.7), (8, 'y' || chr(10) || 'z', 0.7), (9, '', 0.0), (10, 'x', 0.7)) AS t(n, latex, confidence)""")
def formula_cases(spark: SparkSession, d: str) -> DataFrame:
    """A recogniser's answers without the fences around them."""
    rows = spark.createDataFrame(list(enumerate(_FENCED)), "n int, raw string")
    return rows.select("n", layout.cleaned_formula(F.col("raw")).alias("latex"), layout.formula_confidence(F.col("raw")).alias("confidence"))


_TEXT = f"SELECT block_id, {STRIP % 'content'} AS t FROM b WHERE block_type = 'formula' AND content IS NOT NULL"


@query(f"""WITH {BLOCKS}, x0 AS ({_TEXT}), x1 AS (SELECT block_id, CASE WHEN NOT starts_with(t, '```') THEN t WHEN contains(t, chr(10)) THEN t[strpos(t, chr(10)) + 1:] ELSE t[4:] END AS t FROM x0),
x2 AS (SELECT block_id, CASE WHEN NOT ends_with(t, '```') THEN t WHEN contains(t, chr(10)) THEN t[1:length(t) - strpos(reverse(t), chr(10))] ELSE t[1:length(t) - 3] END AS t FROM x1)
SELECT block_id, CASE WHEN t = '``````' THEN '' ELSE {STRIP % 't'} END AS latex, CASE WHEN t IN ('', '``````') THEN 0.0 WHEN starts_with(t, '$$') THEN 0.85 ELSE 0.7 END::DOUBLE AS formula_confidence FROM x2""")
def formulas(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("block_type = 'formula' and content is not null")
    return b.select("block_id", layout.cleaned_formula(F.col("content")).alias("latex"), layout.formula_confidence(F.col("content")).alias("formula_confidence"))


@query(f"""WITH {BLOCKS} SELECT block_id, CASE WHEN t = '' THEN '' WHEN t LIKE '$$%' THEN t ELSE '$$' || t || '$$' END AS latex, CASE WHEN t = '' THEN 0.0 ELSE 0.85 END::DOUBLE AS confidence
FROM (SELECT block_id, {STRIP % "coalesce(content, '')"} AS t FROM b WHERE block_type IN ('formula', 'figure'))""")
def wrapped_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The contents of formulas and figures as displayed mathematics."""
    b = _blocks(spark, d).where("block_type in ('formula', 'figure')")
    return b.select("block_id", layout.wrapped_formula(F.col("content")).alias("w")).select("block_id", "w.*")


@query("SELECT * FROM (VALUES (0, 601), (1, 601), (20, 31), (299, 3), (300, 3), (301, 2), (599, 2), (600, 1), (4000, 1)) AS t(width, scale)")
def image_scale(spark: SparkSession, d: str) -> DataFrame:
    """Enlargement of formula images by width."""
    rows = spark.createDataFrame([(w,) for w in (0, 1, 20, 299, 300, 301, 599, 600, 4000)], "width int")
    return rows.select("width", layout.image_scale(F.col("width")).alias("scale"))


@query("SELECT block_id, CASE WHEN m > 1024 THEN CAST(floor(w * (1024.0::DOUBLE / m)) AS INTEGER) ELSE CAST(floor(w) AS INTEGER) END AS width, CASE WHEN m > 1024 THEN CAST(floor(h * (1024.0::DOUBLE / m)) AS INTEGER) ELSE CAST(floor(h) AS INTEGER) END AS height FROM (SELECT *, greatest(w, h) AS m FROM (SELECT block_id, (bbox.x1 - bbox.x0) * 3 AS w, (bbox.y1 - bbox.y0) * 3 AS h FROM (" + f"WITH {BLOCKS} SELECT * FROM b" + ") WHERE bbox IS NOT NULL AND block_type IN ('figure', 'table')))")
def capped_images(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the regions' images, rendered three times as large, after the longest edge is capped."""
    b = _blocks(spark, d).where("bbox is not null and block_type in ('figure', 'table')")
    size = layout.capped_size((F.col("bbox.x1") - F.col("bbox.x0")) * 3, (F.col("bbox.y1") - F.col("bbox.y0")) * 3)
    return b.select("block_id", size.alias("z")).select("block_id", "z.*")


@query("""SELECT * FROM (VALUES (0, 'image/png'), (1, 'image/jpeg'), (2, 'image/gif'), (3, 'image/gif'), (4, 'image/bmp'), (5, 'image/png'), (6, 'image/png'), (7, 'image/png')) AS t(n, mime)""")
def mime_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of images by their first bytes; GIF88 and a JPEG cut after two bytes are unknown."""
    heads = [b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff\xe0", b"GIF87a..", b"GIF89a", b"BM..", b"GIF88a..", b"\xff\xd8\x00", b""]
    rows = spark.createDataFrame([(n, bytearray(h)) for n, h in enumerate(heads)], "n int, head binary")
    return rows.select("n", layout.mime_type(F.col("head")).alias("mime"))


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id || '/' || page_num AS doc_id, CASE block_type WHEN 'title' THEN 'title' WHEN 'table' THEN 'table' ELSE 'text' END AS category, bbox FROM b WHERE bbox IS NOT NULL AND block_idx % 7 <> 3),
o AS (SELECT doc_id, category, bbox, row_number() OVER (PARTITION BY doc_id ORDER BY bbox.y0 / 2, bbox.x0 / 2, category) - 1 AS reading_order FROM r)
SELECT doc_id, category, count(*) AS n, round(sum(bbox.x1 / 2), 4) AS x1, CAST(sum(reading_order) AS BIGINT) AS orders FROM o GROUP BY ALL""")
def model_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Raw boxes as a layout model gives them, here made from the blocks' own: each seventh has a class below 0."""
    b = _blocks(spark, d).where("bbox is not null")
    label = F.when(F.col("block_type") == "title", "doc_title").when(F.col("block_type") == "table", "table")
    cls = F.when(F.col("block_idx") % 7 == 3, -1).otherwise(1)
    raw = b.select(F.concat_ws("/", "doc_id", "page_num").alias("doc_id"), "page_num", cls.alias("cls_id"), label.alias("label"), F.lit(None).cast("double").alias("score"), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("coordinate"))
    out = scorers.parsed_boxes(raw, 2.0)
    return out.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.round(F.sum("bbox.x1"), 4).alias("x1"), F.sum("reading_order").alias("orders"))


@query(f"""WITH {BLOCKS}, im AS (SELECT doc_id, page_num, block_id AS image_id, bbox AS r FROM b WHERE block_type = 'figure'),
el AS (SELECT doc_id, page_num, block_idx, block_type, bbox FROM b WHERE block_type IN ('table', 'formula', 'figure') AND bbox IS NOT NULL),
ht AS (SELECT image_id, arg_min(block_type, {{'i': block_idx, 'k': block_type}}) AS kind FROM im JOIN el USING (doc_id, page_num) WHERE r IS NOT NULL AND NOT (r.x1 < bbox.x0 OR bbox.x1 < r.x0 OR r.y1 < bbox.y0 OR bbox.y1 < r.y0) GROUP BY image_id)
SELECT image_id, coalesce(kind, 'figure') AS category FROM im LEFT JOIN ht USING (image_id)""")
def image_route(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    images = b.where("block_type = 'figure'").select("doc_id", "page_num", F.col("block_id").alias("image_id"), F.col("block_type").alias("category"), "bbox")
    elements = b.select("doc_id", "page_num", F.col("block_idx").alias("element_idx"), F.col("block_type").alias("category"), "bbox")
    return scorers.routed_images(images, elements).select("image_id", "category")


@query(f"SELECT DISTINCT doc_id, page_num FROM pages WHERE length({STRIP % "coalesce(text, '')"}) = 0")
def pages_to_recognise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages", "doc_id", "page_num", "text")
    return p.where(F.length(T.strip(F.coalesce("text", F.lit("")))) == 0).select("doc_id", "page_num").distinct()


@query(f"WITH {BLOCKS} SELECT block_id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM b WHERE bbox IS NOT NULL")
def recognised_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes around corner points, here the corners of the blocks' own."""
    b = _blocks(spark, d).where("bbox is not null")
    p = lambda x, y: F.array(F.col(f"bbox.{x}"), F.col(f"bbox.{y}"))
    out = b.select("block_id", scorers.recognised_box(F.array(p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))).alias("r"))
    return out.select("block_id", "r.x0", "r.y0", "r.x1", "r.y1")


# tables

_ROWS = f"""ln AS (SELECT block_id AS id, list_filter(list_transform(string_split(content, chr(10)), lambda s: {STRIP % "s"}), lambda s: contains(s, '|')) AS lines FROM b WHERE content IS NOT NULL),
dt AS (SELECT id, list_transform(list_filter(lines, lambda s: NOT regexp_full_match(s, '[|\\- ]+')), lambda s: list_transform(string_split(regexp_replace(regexp_replace(s, '^\\|+', ''), '\\|+$', ''), '|'), lambda c: {STRIP % "c"})) AS data FROM ln WHERE len(lines) >= 2),
rw AS (SELECT id, CAST(generate_subscripts(data, 1) - 1 AS INTEGER) AS row_index, unnest(data) AS cells, len(data[1]) AS width FROM dt)"""


def _table_rows(spark: SparkSession, d: str) -> DataFrame:
    return tab.markdown_rows(_blocks(spark, d), "block_id", "content")


@query(f"WITH {BLOCKS}, {_ROWS} SELECT id, row_index, CAST(generate_subscripts(cells[1:width], 1) - 1 AS INTEGER) AS col_index, unnest(cells[1:width]) AS text, row_index = 0 AS is_header FROM rw")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return tab.cells(_table_rows(spark, d))


@query(f"""WITH {BLOCKS}, {_ROWS}, mx AS (SELECT id, max(len(cells[1:width])) AS n FROM rw GROUP BY id),
li AS (SELECT id, row_index::DOUBLE AS pos, '| ' || array_to_string(list_transform(range(n), lambda k: coalesce(cells[1:width][k + 1], '')), ' | ') || ' |' AS line FROM rw JOIN mx USING (id)
UNION ALL SELECT id, 0.5, '| ' || array_to_string(list_transform(range(n), lambda k: '---'), ' | ') || ' |' FROM mx)
SELECT id, string_agg(line, chr(10) ORDER BY pos) AS markdown FROM li GROUP BY id""")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return tab.rendered(tab.cells(_table_rows(spark, d)))


@query("""SELECT * FROM (VALUES ('t', '| h | k |' || chr(10) || '| --- | --- |' || chr(10) || '| aa |  |'), ('u', '| x |' || chr(10) || '| --- |' || chr(10) || '| y |')) AS t(id, markdown)""")
def duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    """Of two cells in one place the later one is shown, whatever its text."""
    rows = [("t", 0, 0, 0, "h"), ("t", 1, 0, 1, "k"), ("t", 2, 1, 0, "zz"), ("t", 3, 1, 0, "aa"), ("t", 4, -1, 0, "lost"), ("u", 0, 0, 0, "x"), ("u", 1, 1, 0, "y")]
    return tab.rendered(spark.createDataFrame(rows, "id string, cell_idx int, row_index int, col_index int, text string"))


@query(f"""WITH {BLOCKS}, x AS (SELECT block_id AS id, list_filter(list_transform(string_split(content, chr(10)), lambda s: {STRIP % 's'}), lambda s: s <> '') AS l FROM b WHERE content IS NOT NULL AND metadata.source IS NOT NULL)
SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS row_index, unnest(l) AS text FROM x""")
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    """Recognised text as tables of one column."""
    return tab.text_table(_blocks(spark, d).where("metadata.source is not null"), "block_id", "content")


@query("""SELECT * FROM (VALUES ('t1', 0, 0, 0, 'a'), ('t1', 1, 9, 0, 'b'), ('t1', 0, 10, 0, 'c'), ('t1', 1, 14, 1, 'd'), ('t3', 0, 0, 0, 'e'), ('t4', 0, 0, 0, 'f'), ('t4', 0, 3, 0, 'g')) AS t(table_id, cell_idx, row_index, col_index, text)""")
def merged_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a continuation stand below its head's, and the third of a run begins anew."""
    tables = [("d", 1, "t1", 10, 3, 1), ("d", 2, "t2", 5, 3, 0), ("d", 3, "t3", 2, 4, 0), ("d", 4, "t4", 3, 3, 0), ("d", 5, "t5", 2, 3, 0)]
    cells = [("t1", 0, 0, 0, "a"), ("t1", 1, 9, 0, "b"), ("t2", 0, 0, 0, "c"), ("t2", 1, 4, 1, "d"), ("t3", 0, 0, 0, "e"), ("t4", 0, 0, 0, "f"), ("t5", 0, 0, 0, "g")]
    t = spark.createDataFrame(tables, "doc_id string, seq int, table_id string, n_rows int, n_cols int, header_rows int")
    c = spark.createDataFrame([(*x, False) for x in cells], "table_id string, cell_idx int, row_index int, col_index int, text string, is_header boolean")
    return tab.merged_cells(t, c).select("table_id", "cell_idx", "row_index", "col_index", "text")


@query(f"WITH {BLOCKS} SELECT block_id, 3 AS page_num, bbox.x0 AS x0, 0 AS num_rows FROM b WHERE lower(block_type) = 'table' AND bbox IS NOT NULL")
def table_objects(spark: SparkSession, d: str) -> DataFrame:
    """Table elements as tables still without cells, on a page of the caller's."""
    e = _blocks(spark, d).where("bbox is not null").select("doc_id", F.col("block_id").alias("element_idx"), F.col("block_type").alias("category"), "bbox")
    return tab.table_objects(e, 3).select(F.col("element_idx").alias("block_id"), "page_num", "bbox.x0", "num_rows")


@query(f"""WITH {BLOCKS}, rg AS (SELECT doc_id, page_num, block_idx, block_id, bbox AS r, confidence FROM b WHERE lower(block_type) IN ('table', 'table_caption', 'table_content') AND bbox IS NOT NULL),
tx AS (SELECT rg.block_id, sum(length(content)) AS chars FROM rg JOIN b USING (doc_id, page_num) WHERE block_type = 'text' AND bbox IS NOT NULL AND NOT (r.x1 < bbox.x0 OR bbox.x1 < r.x0 OR r.y1 < bbox.y0 OR bbox.y1 < r.y0) GROUP BY rg.block_id)
SELECT doc_id, page_num, '| ' || block_idx || ' |' AS content, confidence FROM rg LEFT JOIN tx USING (block_id) WHERE coalesce(chars, 0) <= 30 AND block_idx % 3 = 0""")
def recovered_tables(spark: SparkSession, d: str) -> DataFrame:
    """Blocks appended for tables whose images were recognised; here two of three answers refuse."""
    b = keep(_blocks(spark, d).select("doc_id", "page_num", "block_idx", "block_id", "content", "block_type", "bbox", "confidence"))
    e = b.select("doc_id", "page_num", F.col("block_idx").alias("element_idx"), F.col("block_type").alias("category"), "confidence", "bbox")
    answer = F.when(F.col("block_idx") % 3 == 0, F.concat(F.lit(" | "), F.col("block_idx").cast("string"), F.lit(" | "))).when(F.col("block_idx") % 3 == 1, "not_a_table").otherwise(" ")
    out = tab.recovered(b, e, b.select("doc_id", "page_num", F.col("block_idx").alias("element_idx"), answer.alias("markdown")))
    return out.where("source = 'table_recovery'").select("doc_id", "page_num", "content", "confidence")


@query(f"WITH {BLOCKS} SELECT block_id, lower(block_type) AS kind FROM b WHERE lower(block_type) IN ('table', 'table_caption', 'table_content')")
def table_regions(spark: SparkSession, d: str) -> DataFrame:
    return tab.table_regions(_blocks(spark, d), "block_type").select("block_id", F.lower("block_type").alias("kind"))


@query("""WITH t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, l_partkey AS table_id, CAST(l_quantity AS INTEGER) AS n_rows, CAST(l_quantity AS INTEGER) % 3 AS n_cols, CAST(l_partkey % 2 AS INTEGER) AS header_rows FROM lineitem),
j AS (SELECT *, coalesce(header_rows = 0 AND n_cols > 0 AND n_cols = lag(n_cols) OVER w, false) AS joins FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM j),
m AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY seq) - 1) // 2 AS pair FROM k)
SELECT doc_id, min(seq) AS seq, arg_min(table_id, seq) AS table_id, CAST(sum(n_rows) AS INTEGER) AS n_rows, count(*) > 1 AS is_page_break FROM m GROUP BY doc_id, run, pair""")
def table_merge(spark: SparkSession, d: str) -> DataFrame:
    """Runs of tables that continue over pages, on tables derived from order lines."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").withColumn("seq", F.row_number().over(order).cast("bigint"))
    n = F.col("l_quantity").cast("int")
    t = rows.select(F.col("l_orderkey").alias("doc_id"), "seq", F.col("l_partkey").alias("table_id"), n.alias("n_rows"), (n % 3).alias("n_cols"), (F.col("l_partkey") % 2).cast("int").alias("header_rows"))
    return tab.merged_over_pages(t)


# chunks


@query(f"WITH {BLOCKS} SELECT block_id, regexp_matches(content, '{chunking.QUESTION}') AND NOT regexp_matches(content, '{chunking.OPTIONS_ONLY}') AS question FROM b WHERE content IS NOT NULL")
def question_flags(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("content is not null").select("block_id", chunking.question(F.col("content")).alias("question"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut into chunks anew, from their blocks."""
    return chunking.chunk_documents(_blocks(spark, d))


@query(f"WITH {CHUNKS} SELECT coalesce(nullif(metadata.chunk_level, ''), 'paragraph') AS level, count(*) AS n FROM c GROUP BY 1")
def chunk_levels(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy(F.coalesce(F.nullif(F.col("metadata.chunk_level"), F.lit("")), F.lit("paragraph")).alias("level")).agg(F.count("*").alias("n"))


# confidence

DIMS = """lq AS (SELECT doc_id, avg(coalesce(nullif(confidence, 0), 0.85)) AS v FROM b GROUP BY doc_id),
oc AS (SELECT doc_id, coalesce(avg(confidence), 0) AS v FROM b GROUP BY doc_id),
ti AS (SELECT doc_id, CASE WHEN count_if(metadata.num_rows > 0 AND metadata.num_cols > 0) = count(*) THEN 1.0 WHEN count_if(metadata.num_rows > 0 AND metadata.num_cols > 0) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM b WHERE block_type = 'table' GROUP BY doc_id),
cc AS (SELECT doc_id, avg(CASE WHEN length(content) > 0 AND metadata IS NOT NULL THEN 1.0 ELSE 0.0 END) AS v FROM c GROUP BY doc_id),
ds AS (SELECT DISTINCT doc_id FROM parsed_documents),
dm AS (SELECT doc_id, coalesce(lq.v, 0) AS layout_quality, coalesce(oc.v, 0) AS ocr_confidence, coalesce(ti.v, 0) AS table_integrity, coalesce(cc.v, 0) AS chunk_coherence FROM ds LEFT JOIN lq USING (doc_id) LEFT JOIN oc USING (doc_id) LEFT JOIN ti USING (doc_id) LEFT JOIN cc USING (doc_id)),
dc AS (SELECT *, round(0.25 * layout_quality + 0.2 * ocr_confidence + 0.15 * table_integrity + 0.2 * chunk_coherence + 0.2, 4) AS overall FROM dm)"""


def _doc_confidence(spark: SparkSession, d: str) -> DataFrame:
    b, c = _blocks(spark, d), _chunks(spark, d)
    tables = b.where("block_type = 'table'").select("doc_id", F.coalesce("metadata.num_rows", F.lit(0)).alias("n_rows"), F.coalesce("metadata.num_cols", F.lit(0)).alias("n_cols"))
    docs = table(spark, d, "parsed_documents", "doc_id")
    return confidence.document_confidence(docs, layout_quality=confidence.layout_quality(layout.layout_elements(b)), ocr_confidence=confidence.ocr_confidence(b), table_integrity=confidence.table_integrity(tables), chunk_coherence=confidence.chunk_coherence(c))


@query(f"WITH {BLOCKS}, {CHUNKS}, {DIMS} SELECT doc_id, round(layout_quality, 6) AS layout_quality, round(ocr_confidence, 6) AS ocr_confidence, table_integrity, round(chunk_coherence, 6) AS chunk_coherence, overall FROM dc")
def doc_confidence(spark: SparkSession, d: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return _doc_confidence(spark, d).select("doc_id", r6("layout_quality"), r6("ocr_confidence"), "table_integrity", r6("chunk_coherence"), "overall")


@query(f"""WITH {BLOCKS}, {CHUNKS}, {DIMS}, ic AS (SELECT c.doc_id, count(*) AS n FROM c SEMI JOIN (SELECT chunk_id FROM vectors WHERE embedding IS NOT NULL) USING (chunk_id) GROUP BY c.doc_id),
x AS (SELECT doc_id, CASE WHEN overall >= 0.75 THEN 'accept' WHEN overall >= 0.4 THEN 'review' ELSE 'reject' END AS category, coalesce(n, 0) AS indexed_count FROM dc LEFT JOIN ic USING (doc_id))
SELECT doc_id, category, indexed_count, category <> 'accept' OR indexed_count = 0 AS needs_review, CASE WHEN category <> 'accept' OR indexed_count = 0 THEN 'review' ELSE 'indexed' END AS status FROM x""")
def doc_review_decision(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "vectors", "chunk_id", "embedding").where("embedding is not null").select("chunk_id").distinct()
    indexed = _chunks(spark, d).join(have, "chunk_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("indexed_count"))
    out = confidence.review_decision(_doc_confidence(spark, d), indexed, retrieval.decision(F.col("overall")))
    return out.select("doc_id", "category", "indexed_count", "needs_review", "status")


# tasks, review, feedback

TASKS = "tk AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'indexed' ELSE 'review' END AS status, o_orderstatus = 'P' AS needs_review, CAST(o_custkey AS VARCHAR) AS filename, o_totalprice FROM orders)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderkey").alias("seq"), F.when(s == "O", "queued").when(s == "F", "indexed").otherwise("review").alias("status"), (s == "P").alias("needs_review"), F.col("o_custkey").cast("string").alias("filename"), "o_totalprice")


FEEDBACK = "fb AS (SELECT DISTINCT * FROM feedback)"


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").distinct()


@query(f"WITH {TASKS} SELECT task_id, row_number() OVER (ORDER BY seq, task_id) AS position FROM tk WHERE status = 'queued'")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    return review.queue_positions(_tasks(spark, d))


@query(f"WITH {TASKS} SELECT status, count(*) AS tasks, round(sum(o_totalprice), 2) AS total FROM tk GROUP BY status")
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).groupBy("status").agg(F.count("*").alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {TASKS}, w AS (SELECT task_id, row_number() OVER (ORDER BY seq, task_id) AS queue_position FROM tk WHERE status = 'queued')
SELECT task_id, status, filename, queue_position, false AS is_processing FROM tk LEFT JOIN w USING (task_id) WHERE task_id = (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)""")
def task_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of one task, here of the latest order."""
    t = _tasks(spark, d)
    last = t.agg(F.max("seq").cast("string").alias("last"))
    out = review.task_status(t.crossJoin(F.broadcast(last)), F.col("last"))  # one row
    return out.select("task_id", "status", "filename", F.col("queue_position").cast("bigint").alias("queue_position"), "is_processing")


@query(f"WITH {TASKS} SELECT task_id, status, CASE WHEN status = 'queued' THEN row_number() OVER (PARTITION BY status ORDER BY seq, task_id) ELSE 0 END AS queue_position FROM tk")
def list_tasks(spark: SparkSession, d: str) -> DataFrame:
    return review.listed(_tasks(spark, d)).select("task_id", "status", F.coalesce("queue_position", F.lit(0)).alias("queue_position"))


@query(f"""WITH {TASKS}, q AS (SELECT task_id, seq, CASE status WHEN 'review' THEN 'processing' ELSE status END AS status FROM tk)
SELECT count_if(status = 'processing')::BIGINT AS running_count, count_if(status = 'queued')::BIGINT AS waiting_count, 2 AS max_concurrent,
(SELECT string_agg(task_id, ',' ORDER BY seq, task_id) FROM (SELECT * FROM q WHERE status = 'processing' ORDER BY seq, task_id LIMIT 5)) AS running,
(SELECT string_agg(task_id, ',' ORDER BY seq, task_id) FROM (SELECT * FROM q WHERE status = 'queued' ORDER BY seq, task_id LIMIT 5)) AS waiting FROM q""")
def queue_lists(spark: SparkSession, d: str) -> DataFrame:
    """The queue's state: counts, and the first tasks that run and wait."""
    t = _tasks(spark, d).withColumn("status", F.when(F.col("status") == "review", "processing").otherwise(F.col("status")))
    out = review.queue_lists(t, 2, 5)
    return out.withColumns({c: F.array_join(c, ",") for c in ("running", "waiting")})


@query(f"""WITH {TASKS} SELECT task_id, CASE WHEN o_totalprice > 150000 AND needs_review THEN 'queued' ELSE status END AS status, needs_review AND NOT o_totalprice > 150000 AS needs_review, CASE WHEN o_totalprice > 150000 AND needs_review THEN '' ELSE 'e' END AS error FROM tk""")
def reprocessed(spark: SparkSession, d: str) -> DataFrame:
    """The task table after some of the tasks in review are sent through the queue again."""
    t = keep(_tasks(spark, d).withColumn("file_path", F.col("filename")).withColumn("error", F.lit("e")))
    return review.requeued(t, t.where("needs_review and o_totalprice > 150000")).select("task_id", "status", "needs_review", "error")


@query(f"""WITH {BLOCKS}, {CHUNKS}, pb AS (SELECT doc_id, page_num, string_agg(block_id || ':' || coalesce(block_type, 'text'), ',' ORDER BY block_idx, block_id) AS bs, sum(length(coalesce(content, ''))) AS tl FROM b GROUP BY ALL),
pd AS (SELECT doc_id, string_agg(page_num || '/' || tl || '/' || bs, ';' ORDER BY page_num) AS pages FROM pb GROUP BY doc_id),
cd AS (SELECT doc_id, count(*) AS total_chunks, string_agg(chunk_id || ':' || coalesce(metadata.chunk_type, 'text') || ':' || coalesce(metadata.section, ''), ';' ORDER BY chunk_seq, chunk_id) AS chunks FROM c GROUP BY doc_id)
SELECT d.doc_id, pages, chunks, coalesce(total_chunks, 0) AS total_chunks FROM (SELECT DISTINCT doc_id FROM parsed_documents) d LEFT JOIN pd USING (doc_id) LEFT JOIN cd USING (doc_id)""")
def review_details(spark: SparkSession, d: str) -> DataFrame:
    """The review payload of every document, flattened to text."""
    tasks = table(spark, d, "parsed_documents", "doc_id").distinct()
    out = review.review_details(tasks, _blocks(spark, d), _chunks(spark, d))
    block = lambda x: F.concat(x["block_id"], F.lit(":"), x["block_type"])
    page = lambda p: F.concat_ws("/", p["page_num"].cast("string"), p["text_length"].cast("string"), F.array_join(F.transform(p["blocks"], block), ","))
    chunk = lambda x: F.concat_ws(":", x["chunk_id"], x["chunk_type"], x["section"])
    return out.select("doc_id", F.array_join(F.transform("pages", page), ";").alias("pages"), F.array_join(F.transform("chunks", chunk), ";").alias("chunks"), "total_chunks")


@query("""SELECT count(*) AS documents, CAST((SELECT count(DISTINCT chunk_id) FROM chunks) AS BIGINT) AS chunks, CAST(count_if(w) AS BIGINT) AS in_work, (SELECT string_agg(doc_id, ',' ORDER BY doc_id DESC) FROM (SELECT DISTINCT doc_id FROM parsed_documents ORDER BY doc_id DESC LIMIT 5)) AS first_five
FROM (SELECT doc_id, bool_or(coalesce(status IN ('queued', 'processing'), false)) AS w FROM parsed_documents WHERE doc_id IS NOT NULL GROUP BY doc_id)""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_documents", "doc_id", "status").where("doc_id is not null")
    docs = keep(p.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("status").isin("queued", "processing"), F.lit(False))).alias("w")))
    a = docs.agg(F.count("*").alias("documents"), F.count_if("w").alias("in_work"))
    per = table(spark, d, "chunks", "doc_id", "chunk_id").where("chunk_id is not null").distinct().select("chunk_id").distinct()
    n = per.agg(F.count("*").alias("chunks"))
    five = docs.orderBy(F.desc("doc_id")).limit(5).agg(F.array_join(F.reverse(F.array_sort(F.collect_list("doc_id"))), ",").alias("first_five"))
    return a.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(five)).select("documents", "chunks", "in_work", "first_five")  # one row each


@query("SELECT doc_id, coalesce(max(filename), '') AS filename, coalesce(max(status), 'uploaded') AS status, coalesce(max(total_pages), 0) AS total_pages FROM parsed_documents GROUP BY doc_id")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_documents").groupBy("doc_id")
    return p.agg(F.coalesce(F.max("filename"), F.lit("")).alias("filename"), F.coalesce(F.max("status"), F.lit("uploaded")).alias("status"), F.coalesce(F.max("total_pages"), F.lit(0)).alias("total_pages"))


@query("""WITH it AS (SELECT text AS q, list_filter(regexp_split_to_array(text, ' '), lambda w: length(w) > 7) AS terms FROM (SELECT DISTINCT text FROM eval_items WHERE text IS NOT NULL)),
an AS (SELECT DISTINCT text AS q, upper(text)[1:60] AS answer, CAST(length(text) % 2 AS INTEGER) AS citations, length(text) % 10 / 10.0::DOUBLE AS confidence FROM eval_items WHERE text IS NOT NULL),
ok AS (SELECT it.q, len(list_filter(terms, lambda t: contains(lower(answer), lower(t)))) > 0 AND citations >= 1 AS passed, citations, confidence FROM it JOIN an USING (q))
SELECT count(*) AS asked, CAST(count_if(passed) AS BIGINT) AS passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(confidence), 6) AS avg_confidence, round(avg(citations), 6) AS avg_citations FROM ok""")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set with several key terms an item: the items' long words, asked of answers made from their beginnings."""
    q = table(spark, d, "eval_items", "text").where("text is not null").distinct()
    items = q.select(F.col("text").alias("q"), F.filter(F.split("text", " "), lambda w: F.length(w) > 7).alias("key_terms"))
    answers = q.select(F.col("text").alias("q"), F.substring(F.upper("text"), 1, 60).alias("answer"), (F.length("text") % 2).alias("citations"), (F.length("text") % 10 / 10).alias("confidence"))
    return review.evaluated(answers, items)


@query("""WITH p AS (SELECT DISTINCT item_id AS key, text FROM eval_items WHERE text IS NOT NULL)
SELECT key, CASE WHEN key % 5 = 0 THEN 'known' WHEN key % 5 = 1 THEN 'no answer' ELSE upper(text)[1:40] END AS answer, key % 5 NOT IN (0, 1) AS store FROM p""")
def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers from the cache, else from a generator; of five items one is cached and one is answered by blanks."""
    p = table(spark, d, "eval_items", "item_id", "text").where("text is not null").distinct().select(F.col("item_id").alias("key"), F.col("text").alias("prompt"))
    p = p.withColumn("prompt", F.when(F.col("key") % 5 == 1, " ").otherwise(F.col("prompt")))
    cache = p.where("key % 5 = 0").select("key", F.lit("known").alias("value"))
    return scorers.cached_answers(p, cache, lambda c: F.substring(F.upper(c), 1, 40))


@query("""SELECT DISTINCT chunk_id, CASE WHEN content IS NULL THEN NULL WHEN length(content) % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS first, CASE WHEN content IS NOT NULL THEN 2 END AS dim FROM (SELECT DISTINCT chunk_id, content FROM chunks)""")
def encode_missing(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all contents: cached ones of the right length, the others encoded; here the contents of even length are cached, those divisible by three with stale vectors."""
    rows = table(spark, d, "chunks", "chunk_id", "content").distinct()
    c = rows.where("content is not null and length(content) % 2 = 0").select(T.content_key(F.col("content")).alias("key"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")).distinct()
    stale = rows.where("content is not null and length(content) % 3 = 0").select(T.content_key(F.col("content")).alias("key"), F.array(F.lit(9.0)).alias("embedding")).distinct()
    out = scorers.encoded(rows, "content", c.unionByName(stale), lambda text: F.array(F.lit(2.0), F.lit(0.0)), 2)
    return out.select("chunk_id", F.get("embedding", F.lit(0)).alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query(f"""WITH {HYBRID} SELECT query_id, id, rank FROM h""")
def retrieve_unscored(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval without a reranker: the fused order stays."""
    contents = _kept_chunks(spark, d).select(F.col("chunk_id").alias("id"), "content", "metadata")
    return retrieval.retrieve(*_rankings(spark, d, 100), contents, _hybrid_queries(spark, d), scorer=None).select("query_id", "id", "rank")


@query(f"WITH {TASKS} SELECT task_id, filename FROM tk WHERE needs_review AND task_id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')")
def pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    decided = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("task_id"))
    return review.pending(_tasks(spark, d), decided).select("task_id", "filename")


@query(f"""WITH {BLOCKS}, {FEEDBACK}, e0 AS (SELECT seq, ts, unnest(edited_blocks) AS e, generate_subscripts(edited_blocks, 1) AS i FROM fb),
e AS (SELECT e.block_id AS block_id, arg_max(e.new_content, {{'s': seq, 'i': i}}) AS new_content FROM e0 WHERE e.block_id IS NOT NULL GROUP BY 1)
SELECT b.block_id, coalesce(new_content, content) AS content, new_content IS NOT NULL AS was_edited FROM b LEFT JOIN e USING (block_id)""")
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    e = _feedback(spark, d).select("seq", F.posexplode("edited_blocks").alias("i", "e")).select("e.block_id", "e.new_content", F.struct("seq", "i").alias("pos"))
    return review.edited(_blocks(spark, d).select("block_id", "content"), e).select("block_id", "content", "was_edited")


@query(f"""WITH {FEEDBACK}, tk AS (SELECT task_id, 'review' AS status, true AS needs_review FROM (SELECT DISTINCT left(metadata.source_file, 12) AS task_id FROM chunks WHERE metadata.source_file IS NOT NULL)),
a AS (SELECT task_id, arg_max(action, seq) AS action FROM fb WHERE action = 'approve' OR (action = 'reject' AND length(trim(reason)) > 0) GROUP BY task_id)
SELECT task_id, CASE action WHEN 'approve' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE status END AS status, needs_review AND action IS NULL AS needs_review FROM tk LEFT JOIN a USING (task_id)""")
def review_transitions(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "chunks", "metadata.source_file").where("source_file is not null").select(F.left("source_file", F.lit(12)).alias("task_id")).distinct().select("task_id", F.lit("review").alias("status"), F.lit(True).alias("needs_review"))
    return review.transitions(tasks, _feedback(spark, d).select("task_id", "action", "reason", "seq"))


@query(f"WITH {FEEDBACK} SELECT count(*) AS total_actions, CAST(count_if(action = 'approve') AS BIGINT) AS approved, CAST(count_if(action = 'reject') AS BIGINT) AS rejected, CAST(count_if(len(edited_blocks) > 0) AS BIGINT) AS with_edits, round(count_if(action = 'approve') / count(*), 3) AS approval_rate, round(count_if(len(edited_blocks) > 0) / count(*), 3) AS edit_rate FROM fb")
def feedback_totals(spark: SparkSession, d: str) -> DataFrame:
    return review.feedback_totals(_feedback(spark, d))


@query(f"WITH {FEEDBACK} SELECT coalesce(e.block_type, 'unknown') AS block_type, count(*) AS edits FROM (SELECT unnest(edited_blocks) AS e FROM fb) GROUP BY 1 ORDER BY edits DESC, block_type LIMIT 10")
def feedback_block_types(spark: SparkSession, d: str) -> DataFrame:
    return review.feedback_block_types(_feedback(spark, d))


@query(f"WITH {FEEDBACK} SELECT coalesce(filename, 'unknown') AS filename, count(*) AS actions, CAST(count_if(len(edited_blocks) > 0) AS BIGINT) AS edits, round(avg(CASE WHEN action = 'approve' THEN 1.0 ELSE 0.0 END), 6) AS approve_rate FROM fb GROUP BY 1")
def feedback_by_file(spark: SparkSession, d: str) -> DataFrame:
    return review.feedback_by_file(_feedback(spark, d))


@query(f"WITH {FEEDBACK} SELECT seq, task_id, action FROM fb ORDER BY seq DESC, task_id LIMIT 10")
def feedback_recent(spark: SparkSession, d: str) -> DataFrame:
    return review.recent_feedback(_feedback(spark, d)).select("seq", "task_id", "action")


@query(f"WITH {BLOCKS} SELECT doc_id, page_num, count(*) AS blocks, string_agg(block_id, ',' ORDER BY block_idx, block_id) AS block_ids FROM b GROUP BY ALL")
def parse_response(spark: SparkSession, d: str) -> DataFrame:
    """Each page's nested blocks, in short: how many and which."""
    p = stores.page_documents(_blocks(spark, d))
    return p.select("doc_id", "page_num", F.size("blocks").cast("bigint").alias("blocks"), F.array_join(F.col("blocks.block_id"), ",").alias("block_ids"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'cached ' || item_id ELSE text END AS search FROM eval_items")
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Rewritings from the cache where there are any, here for every third item."""
    q = _items(spark, d)
    cache = q.where("query_id % 3 = 0").select("query", F.concat(F.lit("cached "), F.col("query_id").cast("string")).alias("rewriting"))
    return scorers.rewritten(q, cache)


@query("SELECT item_id AS query_id, 'Context:' || chr(10) || lang || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' AS prompt FROM eval_items")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items", "item_id", "lang", "text")
    return q.select(F.col("item_id").alias("query_id"), scorers.prompt("qa", context=F.col("lang"), query=F.col("text")).alias("prompt"))


@query("SELECT DISTINCT sha256(text)[1:16] AS key FROM eval_items WHERE item_id % 2 = 0")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Live entries of the answer cache: those of even items; the others expired an hour ago."""
    q = table(spark, d, "eval_items", "item_id", "text")
    now = F.current_timestamp()
    live = stores.cache_entries(q.where("item_id % 2 = 0"), "answer", T.content_key(F.col("text")), F.col("item_id"))
    old = stores.cache_entries(q.where("item_id % 2 = 1"), "answer", T.content_key(F.col("text")), F.col("item_id"), now - F.expr("interval 2 hours"))
    return stores.cached(live.unionByName(old), "answer").select("key")


# events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ingest.tumbling(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_status(table(spark, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").withColumnRenamed("event_type", "status")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
