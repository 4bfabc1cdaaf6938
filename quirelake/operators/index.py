"""Keyword and vector indexes, and searches over them for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import keep

Tokenizer = Callable[[Column], Column]


@dataclass
class KeywordIndex:
    """``postings(term, id, tf, dl)``, ``terms(term, df, idf)``, ``stats(n, avgdl)`` of a corpus, and what cuts texts into terms.

    ``cut(id, ts)``: the texts' terms, a row an id, where searches may read them in place.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    tokenizer: Tokenizer = tokens
    cut: DataFrame | None = None


#: Repeated keys up to which they are sent to the rows, which then stay where they are.
SENT_KEYS = 100_000


def distinct_by(df: DataFrame, key: str, one: Callable[[DataFrame], DataFrame], *, sent: int | None = None) -> DataFrame:
    """``one(df)``, which takes rows of equal keys together and leaves a row alone as it is; keys aren't null.

    Only keys and the rows of repeated ones are shuffled and kept; the others are read where they lie, at each read. Of more than ``sent`` repeated keys
    a map is sent instead, and the few rows whose keys it can't tell from repeated ones are gathered too.
    """
    again = keep(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    n = again.count()
    if n > (SENT_KEYS if sent is None else sent):
        held = keep(_key_map(again, key))
        return _mapped(df, key, held, "left_anti").unionByName(keep(one(_mapped(df, key, held, "left_semi"))))
    few = one(df.join(F.broadcast(again), key, "left_semi")).coalesce(1 + n // 10_000)  # searches give k rows a query and task
    return df.join(F.broadcast(again), key, "left_anti").unionByName(keep(few))


#: Bits of a map of keys (8 MB); a key is the bit of its hash.
KEY_BITS = 1 << 26


def _key_bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1


def _key_map(keys: DataFrame, key: str) -> DataFrame:
    """``_part``, ``_bits``: the map of ``keys``, in parts of 4 KB, of which only those with a key are there."""
    parts = keys.select(_key_bit(key).alias("_bit")).withColumn("_part", F.bitmap_bucket_number("_bit")).repartition("_part")
    return parts.groupBy("_part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))


def _mapped(df: DataFrame, key: str, held: DataFrame, how: str) -> DataFrame:
    """The rows of ``df`` whose key is in the map ``held`` (left_semi), or isn't (left_anti); they stay where they are."""
    at = F.bitmap_bit_position(_key_bit(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(held), (F.bitmap_bucket_number(_key_bit(key)) == F.col("_part")) & (F.getbit(byte, (at % 8).cast("int")) == 1), how)


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is one of ``keys``, however many, and a small part of the others; none is shuffled."""
    return _mapped(df, key, _key_map(keys, key), "left_semi")


def keyword_postings(corpus: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """``term``, ``id``, ``tf``, ``dl`` (tokens of the text); every text is cut once."""
    rows = corpus.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokenizer(F.col(text)).alias("ts"))
    rows = rows.select("id", "ts", F.size("ts").alias("dl"))  # before the rows multiply; an outer explode, as the other one would cut the texts again for its own filter
    return rows.select("id", "dl", F.explode_outer("ts").alias("term")).where("term is not null").groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def weighed(postings: DataFrame, n: DataFrame, tokenizer: Tokenizer = tokens, *, epsilon: float = 0.25, floor: float = 0.1) -> KeywordIndex:
    """The index over kept or stored ``postings``; ``n`` is one row with the number of texts."""
    all_ = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all"))
    return KeywordIndex(postings, *_statistics(postings.groupBy("term").agg(F.count("*").alias("df")), all_, n, epsilon, floor), tokenizer)


def _statistics(df: DataFrame, all_: DataFrame, n: DataFrame, epsilon: float, floor: float) -> tuple[DataFrame, DataFrame]:
    """``terms`` and ``stats`` from the texts a term is in, one row with the number of tokens and one with that of texts."""
    stats = all_.crossJoin(F.broadcast(n)).select("n", F.when(F.col("n") > 0, F.col("all") / F.col("n")).otherwise(0.0).alias("avgdl"))  # one row each
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    raw = keep(raw)
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.greatest(F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")), F.lit(floor)).alias("idf"))  # one row
    return terms, stats


def keyword_index(corpus: DataFrame, key: str, text: str, *, tokenizer: Tokenizer = tokens, epsilon: float = 0.25, floor: float = 0.1, unique: bool = False) -> KeywordIndex:
    """Term statistics over the whole corpus.

    The idf is ln(n - df + .5) - ln(df + .5); a negative one is replaced by ``epsilon`` times the mean of all,
    and none is below ``floor``. Texts without tokens count in n and in the mean length. ``tokenizer`` takes a
    column of texts and gives one of arrays of terms (a segmenter with a dictionary is a pandas UDF of that form).
    ``unique`` states that ``corpus`` has one row an id: then nothing but a row per term is shuffled and kept, and searches read the texts where they lie.
    """
    n = corpus.agg(F.count(text).alias("n"))
    if unique:
        n = keep(n)
        cut = corpus.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokenizer(F.col(text)).alias("ts"))
        each = cut.select(F.size("ts").alias("dl"), F.array_distinct("ts").alias("ts")).select("dl", F.posexplode_outer("ts").alias("at", "term")).where("term is not null")
        df = keep(_in_few(each).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("at") == 0, F.col("dl"))).alias("dl")))  # a text's length stands at its first term
        made = _statistics(df.select("term", "df"), df.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("all")), n, epsilon, floor)
        return KeywordIndex(keyword_postings(corpus, key, text, tokenizer), *made, tokenizer, cut)
    return weighed(keep(keyword_postings(corpus, key, text, tokenizer)), n, tokenizer, epsilon=epsilon, floor=floor)


def ranked(scored: DataFrame, k: int, query: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """The ``k`` best of every query with their rank; ties by key. Only k rows a query pass the shuffle."""
    order = W.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_of_ties(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Of every run of equal scores the ``k`` first by place: no other one can be among the ``k`` best."""
    order = np.lexsort((place, -score))
    new = np.flatnonzero(np.diff(score[order], prepend=np.nan) != 0)
    return order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]


def _in_few(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, at most: what each of them gives per query or term is shuffled, so their number must not grow with the rows."""
    return df.coalesce(max(4, df.sparkSession.sparkContext.defaultParallelism))


class _Best:
    """Of what a task has seen, the rows that may be among the ``k`` best of their query once scores are rounded to 6 digits and ties go by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)  # what a row must come near, by query
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.trimmed, self.rows = 0, 0

    def add(self, number: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.held.append((number, ids, score))
        self.rows += len(number)
        if self.rows > 1.5 * self.trimmed:
            self.trim()

    def trim(self) -> None:
        number, ids, score = (np.concatenate([x[0] for x in self.held]), pa.concat_arrays([x[1] for x in self.held]), np.concatenate([x[2] for x in self.held]))
        order = np.lexsort((-score, number))
        number, score = number[order], score[order]
        start = np.flatnonzero(np.diff(number, prepend=-1))
        size = np.diff(np.append(start, len(number)))
        full = start[size >= self.k]
        self.floor[number[full]] = score[full + self.k - 1]
        good = np.flatnonzero(score >= self.floor[number] - 2e-6)
        number, score, order = number[good], score[good], order[good]
        # scores that surely are the same after rounding; those that lie near a half only with their equals
        part = np.abs(score) * 1e6
        value = np.where(np.abs(part - np.floor(part) - 0.5) < 1e-3, score, np.rint(score * 1e6) / 1e6)
        new = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(value, prepend=np.nan) != 0))
        size = np.diff(np.append(new, len(number)))
        if (size > self.k).any():
            group = np.repeat(np.arange(len(new)), size)
            many = np.flatnonzero(np.repeat(size > self.k, size))
            place = np.zeros(len(number), dtype=np.int64)
            place[many[pc.array_sort_indices(ids.take(pa.array(order[many]))).to_numpy()]] = np.arange(len(many))
            by = np.lexsort((place, group))
            by = by[np.arange(len(by)) - np.repeat(new, size) < self.k]
            number, score, order = number[by], score[by], order[by]
        self.held, self.trimmed, self.rows = [(number, ids.take(pa.array(order)), score)], len(number), len(number)

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.trim()
            number, ids, score = self.held[0]
            whole = pa.RecordBatch.from_arrays([names.take(pa.array(number)), ids, pa.array(score)], names=["query_id", "id", "score"])
            for first in range(0, len(number), 10_000):
                yield whole.slice(first, 10_000)


@dataclass
class _Asked:
    """Queries as terms of ``vocabulary`` with weights; query i has those from ``start[i]`` to ``start[i + 1]``."""

    names: pa.Array
    vocabulary: pa.Array
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _matching(ids: pa.Array, ts: pa.Array, asked: _Asked, k: int, k1: float, b: float, avgdl: float, floor: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query numbers, ids, scores): of these texts the ``k`` best of every query, and all that may tie with the last after rounding; none well below the query's ``floor``."""
    offsets = ts.offsets.to_numpy()
    n, dl = len(ids), np.diff(offsets)
    term = pc.fill_null(pc.index_in(ts.values.slice(offsets[0], offsets[-1] - offsets[0]), value_set=asked.vocabulary), -1).to_numpy()
    row = np.repeat(np.arange(n), dl)
    both, tf = np.unique(term[term >= 0].astype(np.int64) * n + row[term >= 0], return_counts=True)
    term, row = np.divmod(both, max(1, n))
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
    bounds = np.searchsorted(term, np.arange(len(asked.vocabulary) + 1))
    place = np.empty(n, dtype=np.int64)
    place[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
    total = np.zeros(n)
    numbers, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for q in range(len(asked.start) - 1):
        own = slice(asked.start[q], asked.start[q + 1])
        for t, weight in zip(asked.term[own], asked.weight[own], strict=True):
            at = slice(bounds[t], bounds[t + 1])
            total[row[at]] += weight * part[at]
        hit = np.flatnonzero(total)
        score = total[hit]
        total[hit] = 0
        if floor[q] > 0:
            best = score >= floor[q] - 2e-6
            hit, score = hit[best], score[best]
        if len(hit) > k:
            best = score >= np.partition(score, len(hit) - k)[len(hit) - k] - 2e-6
            hit, score = hit[best], score[best]
        if len(hit) > 2 * k:
            best = _first_of_ties(score, place[hit], k)
            hit, score = hit[best], score[best]
        numbers.append(np.full(len(hit), q))
        places.append(hit)
        scores.append(score)
    return np.concatenate(numbers), ids.take(pa.array(np.concatenate(places))), np.concatenate(scores)


def _search_in_place(index: KeywordIndex, weighted: DataFrame, k: int, k1: float, b: float, allowed: DataFrame | None, sent: int) -> DataFrame | None:
    """``keyword_search`` over the texts where they lie, for a query set of at most ``sent`` bytes; queries of the same terms are one. None for a larger one."""
    bags = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times", "idf"))).alias("bag"))  # as long as the query
    bags = keep(bags.withColumn("leader", F.min("query_id").over(W.partitionBy("bag"))))
    own = bags.where("query_id = leader")
    cost = F.aggregate("bag", F.lit(0).cast("bigint"), lambda a, x: a + 4 * F.length(x["term"]) + 32)
    if own.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("n")).first().n > sent:
        return None
    kind, asked_kind = dict(index.cut.dtypes)["id"], dict(bags.dtypes)["query_id"]
    own = own.select("query_id", "bag").toArrow().combine_chunks()  # its size was just checked
    bag, first = own.column("bag").combine_chunks(), index.stats.first()
    terms = bag.flatten()
    coded = pc.dictionary_encode(terms.field("term"))
    weight = terms.field("times").to_numpy() * terms.field("idf").to_numpy()
    asked = _Asked(own.column("query_id").combine_chunks(), coded.dictionary, np.cumsum([0, *pc.list_value_length(bag).to_pylist()]), coded.indices.to_numpy(), weight)
    shared, avgdl = bags.sparkSession.sparkContext.broadcast(asked), first.avgdl if first else 0.0

    def work(batches):
        asked = shared.value
        best = _Best(len(asked.names), k)
        for batch in batches:
            if batch.num_rows and len(asked.names):
                best.add(*_matching(batch.column(0), batch.column(1), asked, k, k1, b, avgdl, best.floor))
        yield from best.batches(asked.names)

    texts = index.cut if allowed is None else index.cut.join(allowed.select("id").distinct(), "id", "left_semi")
    scored = _in_few(texts.select("id", "ts")).mapInArrow(work, f"query_id {asked_kind}, id {kind}, score double")
    best = ranked(scored.select(F.col("query_id").alias("leader"), "id", F.round("score", 6).alias("score")).where("score > 0"), k, "leader")
    return bags.select("query_id", "leader").join(best, "leader").select("query_id", "id", "score", "rank")


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int = 10, *, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None, sent: int | None = None) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank`` by Okapi BM25; ``queries`` has query_id and query.

    Every occurrence of a token in the query adds. ``allowed(id)`` masks results, not statistics.
    Blank queries and queries without a known token have no rows; scores are rounded to 6 digits
    before they are ranked, ties go by id, and no score is 0 or less. If the index has its texts' terms, a query set of at most ``sent``
    bytes is sent to the texts, which stay where they are; otherwise the postings of every asked term are joined.
    """
    asked = queries.select("query_id", F.explode(index.tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if index.cut is not None:
        found = _search_in_place(index, asked.join(index.terms.select("term", "idf"), "term"), k, k1, b, allowed, SENT if sent is None else sent)
        if found is not None:
            return found
    hits = index.postings if allowed is None else index.postings.join(allowed.select("id").distinct(), "id", "left_semi")
    hits = asked.join(index.terms, "term").join(hits, "term").crossJoin(F.broadcast(index.stats))  # one row
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, k)


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v``: distinct non-null, non-zero vectors scaled to length 1, as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector))
    rows = distinct_by(rows, "id", DataFrame.distinct).select("id", v.alias("v")).withColumn("norm", norm).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


#: Query vectors up to so many bytes are sent to every executor; beyond, both sides meet in tiles of so many rows.
SENT, TILE = 64_000_000, 4096


def _near(ids: pa.Array, vectors: pa.Array, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query numbers, ids, cosines): of these vectors the ``k`` nearest to every query of their length, and all that tie with the last after rounding; none well below the query's ``floor``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    numbers, places, scores = [], [], []
    for n, (q, x) in asked.items():
        at = np.flatnonzero(sizes == n)
        if not len(at):
            continue
        u = flat[(offsets[at][:, None] + np.arange(n)).ravel()].reshape(-1, n)
        for first in range(0, len(x), 1024):
            cosine = x[first : first + 1024] @ u.T
            last = np.partition(cosine, len(at) - k, 1)[:, len(at) - k] if len(at) > k else np.full(len(cosine), -np.inf)
            if floor is not None:
                last = np.maximum(last, floor[q[first : first + 1024]])
            row, col = np.nonzero(cosine >= last[:, None] - 2e-6)
            numbers.append(q[first + row])
            places.append(at[col])
            scores.append(cosine[row, col])
    cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, dtype=kind)
    return cat(numbers, np.int64), ids.take(pa.array(cat(places, np.int64))), cat(scores, np.float64)


def _by_length(numbers: np.ndarray, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    return {int(n): (numbers[sizes == n], np.array([v for v in vectors if len(v) == n], dtype=np.float64)) for n in np.unique(sizes)}


def vector_search(units: DataFrame, queries: DataFrame, k: int = 10, *, sent: int = SENT, tile: int = TILE) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank`` by cosine; ``queries`` has query_id and v, both sides scaled.

    A stated query set is held against all rows in blocks, as matrix products over Arrow batches of which only
    the ``k`` best of a batch and query come out. Queries of at most ``sent`` bytes are sent to the rows, which stay where they
    are; a larger set meets the rows tile by tile. Other lengths than the query's score nothing.
    """
    kind, asked_kind = dict(units.dtypes)["id"], dict(queries.dtypes)["query_id"]
    queries = keep(queries.select("query_id", "v"))
    size = queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first().n * 8
    if size <= sent:
        own = queries.toArrow()  # its size was just checked
        names, vectors = own.column("query_id").combine_chunks(), own.column("v").to_pylist()
        shared = units.sparkSession.sparkContext.broadcast((names, _by_length(np.arange(len(vectors)), vectors)))

        def work(batches):
            names, asked = shared.value
            best = _Best(len(names), k)
            for b in batches:
                best.add(*_near(b.column(0), b.column(1), asked, k, best.floor))
            yield from best.batches(names)

        scored = _in_few(units.select("id", "v")).mapInArrow(work, f"query_id {asked_kind}, id {kind}, score double")
    else:
        many = lambda df: max(1, -(-df.count() // tile))
        across, down = many(units), many(queries)
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = units.select(place("id", across).alias("m"), each(down).alias("q"), F.col("id"), F.lit(None).cast(asked_kind).alias("query_id"), "v")
        asking = queries.select(each(across).alias("m"), place("query_id", down).alias("q"), F.lit(None).cast(kind).alias("id"), "query_id", "v")

        def meet(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            one = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
            kept, asks = t.filter(pc.is_valid(t.column("id"))), t.filter(pc.is_valid(t.column("query_id")))
            number, ids, score = _near(one(kept, "id"), one(kept, "v"), _by_length(np.arange(asks.num_rows), asks.column("v").to_pylist()), k)
            return pa.table({"query_id": one(asks, "query_id").take(pa.array(number)), "id": ids, "score": pa.array(score)})

        scored = rows.unionByName(asking).groupBy("m", "q").applyInArrow(meet, f"query_id {asked_kind}, id {kind}, score double")
    return ranked(scored.select("query_id", "id", F.round("score", 6).alias("score")), k)


def fused(first: DataFrame, second: DataFrame, k: int = 10, *, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank): the sum of 1 / (constant + rank), ties by id."""
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = first.select("query_id", "id", F.col("rank").alias("r1")).join(second.select("query_id", "id", F.col("rank").alias("r2")), ["query_id", "id"], "full")
    return ranked(both.select("query_id", "id", F.round(part("r1") + part("r2"), 6).alias("score"), "r1", "r2"), k)


def upserted(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``index`` with ``rows`` in place of what had their keys."""
    return index.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def without_source(index: DataFrame, source: str, name: str | Column) -> DataFrame:
    """``index`` without the rows of one source; rows without a source stay."""
    return index.where(F.coalesce(F.col(source) != name, F.lit(True)))


def removed_count(index: DataFrame, source: str, name: str | Column) -> DataFrame:
    """One row: how many rows ``without_source`` takes away, and how many stay."""
    gone = F.coalesce(F.col(source) == name, F.lit(False))
    return index.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def collection_size(index: DataFrame) -> DataFrame:
    """One row: the exact number of rows."""
    return index.agg(F.count("*").alias("rows"))


def open_collection(spark: SparkSession, path: str, dim: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The vector collection at ``path``, made empty if there is none; an error if it holds vectors of another length than ``dim``."""
    schema = f"{key} string, source_file string, {vector} array<float>"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    held = spark.read.schema(schema).parquet(path)
    other = held.where(F.size(vector) != dim).select(F.size(vector).alias("n")).first()
    if other is not None:
        raise ValueError(f"the collection holds vectors of {other.n} values, not {dim}")
    return held
