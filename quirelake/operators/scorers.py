"""Where models plug in: a scorer takes columns and gives columns; chains fall back from one to the next.

Recognisers, encoders, rerankers, rewriters and generators are callers' functions from columns to a
column (a pandas UDF over Arrow batches, as a rule). What surrounds them is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_key, tokens
from .layout import category, touching

Scorer = Callable[..., Column]
NOTHING = ("NOT_FORMULA", "NOT_A_TABLE", "")
UNREADABLE = "[无法识别]"


def first_of(*scorers: Scorer) -> Scorer:
    """The first scorer whose answer isn't null, blank or a refusal."""

    def chain(*args: Column) -> Column:
        answers = [F.trim(s(*args)) for s in scorers]
        return F.coalesce(*[F.when(~a.isin(*NOTHING), a) for a in answers])

    return chain


def recognised_images(images: DataFrame, formula: Scorer, table: Scorer, other: Scorer) -> DataFrame:
    """``images`` (category, image) with ``text``: formulas and tables by their own scorer, what these miss by the next, and a mark if none can."""
    by = {"formula": first_of(formula), "table": first_of(table, formula, other)}
    rest = first_of(formula, other)
    text = F.when(F.col("category") == "formula", by["formula"](F.col("image"))).when(F.col("category") == "table", by["table"](F.col("image"))).otherwise(rest(F.col("image")))
    return images.withColumn("text", F.coalesce(text, F.lit(UNREADABLE)))


def placeholder_filled(content: Column, number: Column, text: Column) -> Column:
    """The content with its first placeholder of that number replaced; as it is, without one."""
    mark = F.concat(F.lit("[IMG_"), number.cast("string"), F.lit("]"))
    at = F.call_function("locate", mark, content)
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), text, F.substring(content, at + F.length(mark), F.length(content)))).otherwise(content)


def parsed_boxes(boxes: DataFrame, scale: float) -> DataFrame:
    """A layout model's raw boxes (doc_id, page_num, cls_id, label, score, coordinate array) as elements in reading order.

    Negative classes and short coordinates are dropped; no label is text, no score 0.5; coordinates are divided by the render scale.
    """
    c = F.col("coordinate")
    good = boxes.where((F.col("cls_id") >= 0) & (F.size("coordinate") >= 4))
    box = F.struct(*[(c[i] / scale).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    rows = good.select("doc_id", "page_num", category(F.coalesce("label", F.lit("text"))).alias("category"), F.coalesce("score", F.lit(0.5)).alias("confidence"), box.alias("bbox"))
    return rows.withColumn("reading_order", F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("bbox.y0", "bbox.x0", "category")) - 1)


def routed_images(images: DataFrame, elements: DataFrame) -> DataFrame:
    """Each image's category: that of the first table, formula or figure element that its box touches, else its own.

    ``images``: doc_id, page_num, image_id, category, bbox; ``elements``: doc_id, page_num, element_idx, category, bbox. Joined by page first.
    """
    e = elements.where(F.col("category").isin("table", "formula", "figure") & F.col("bbox").isNotNull()).select("doc_id", "page_num", "element_idx", F.col("category").alias("kind"), F.col("bbox").alias("e"))
    hit = images.where("bbox is not null").join(e, ["doc_id", "page_num"]).where(touching("bbox", "e")).groupBy("image_id").agg(F.min_by("kind", F.struct("element_idx", "kind")).alias("kind"))
    return images.join(hit, "image_id", "left").withColumn("category", F.coalesce("kind", "category")).drop("kind")


def recognised_box(points: Column) -> Column:
    """The box around a recogniser's corner points (array of x, y arrays)."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def described_figures(blocks: DataFrame, described: DataFrame, least: int = 10, prefix: str = "[图表描述] ") -> DataFrame:
    """``blocks`` and, at the end of each page, a text block per description longer than ``least`` characters.

    ``described``: doc_id, page_num, figure_idx, text.
    """
    good = described.where(F.length(F.trim("text")) > least)
    last = blocks.groupBy("doc_id", "page_num").agg(F.max("block_idx").alias("last"))
    place = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("figure_idx"))
    more = good.join(last, ["doc_id", "page_num"], "left").select("doc_id", "page_num", (F.coalesce("last", F.lit(-1)) + place).cast("int").alias("block_idx"), F.concat(F.lit(prefix), F.trim("text")).alias("content"), F.lit("text").alias("block_type"))
    return blocks.unionByName(more, allowMissingColumns=True)


def rewritten(queries: DataFrame, cache: DataFrame, rewriter: Scorer | None = None) -> DataFrame:
    """``query_id``, ``search``: the cached rewriting, else the rewriter's, else the query; each distinct query is rewritten once."""
    known = queries.select("query").distinct().join(cache.select("query", "rewriting"), "query", "left")
    new = rewriter(F.col("query")) if rewriter else F.lit(None).cast("string")
    search = F.coalesce(F.nullif(F.trim("rewriting"), F.lit("")), F.nullif(F.trim(new), F.lit("")), F.col("query"))
    return queries.join(known.select("query", search.alias("search")), "query").select("query_id", "search")


def hashing_encoder(dim: int = 64) -> Scorer:
    """A deterministic stand-in for an encoder, in expressions: each distinct token adds +1 or -1 to one of ``dim`` places, scaled to length 1; no tokens, all zero."""

    def encode(text: Column) -> Column:
        words = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(dim)) == k, F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))

    return encode


def encoded(rows: DataFrame, text: str, cache: DataFrame, encoder: Scorer, dim: int) -> DataFrame:
    """``rows`` with ``embedding``: the cached vector of the text's key if it has ``dim`` values, else the encoder's; each missing text is encoded once.

    ``cache``: key, embedding. Null texts have no vector.
    """
    keyed = rows.withColumn("_key", content_key(F.col(text)))
    good = cache.where(F.size("embedding") == dim).groupBy("key").agg(F.min("embedding").alias("cached"))
    known = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.min(text).alias("_text")).join(good, F.col("_key") == F.col("key"), "left")
    vectors = known.where("cached is not null").select("_key", F.col("cached").alias("embedding")).unionByName(known.where("cached is null").select("_key", encoder(F.col("_text")).alias("embedding")))
    return keyed.join(vectors, "_key", "left").drop("_key")


def cached_answers(prompts: DataFrame, cache: DataFrame, generator: Scorer | None, *, tries: int = 3, fallback: str = "no answer") -> DataFrame:
    """``key``, ``answer``, ``store``: the cached answer of each prompt (key, prompt), else the generator's, asked up to ``tries`` times while it is blank.

    Without a generator, or when all tries are blank, the answer is ``fallback``. Only new answers that aren't blank are to be stored.
    A generator that fails must give null; it is called as a column, so a pandas UDF waits between its own tries.
    """
    have = prompts.join(cache.select("key", F.col("value").alias("cached")), "key", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    new = F.lit(None).cast("string")
    for _ in range(tries if generator else 0):
        new = F.when(blank(new), generator(F.col("prompt"))).otherwise(new)
    rows = have.withColumn("new", F.when(F.col("cached").isNull(), new))
    return rows.select("key", F.coalesce("cached", F.when(~blank(F.col("new")), F.col("new")), F.lit(fallback)).alias("answer"), (F.col("cached").isNull() & ~blank(F.col("new"))).alias("store"))


TEMPLATES = {"qa": "Context:\n{context}\n\nQuestion: {query}\n\nAnswer:", "rewrite": "Question: {query}\nRewritten for search:"}


def prompt(template: str, **values: Column) -> Column:
    """A named template with its fields filled; an unknown name or a missing field is an error."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template: {template}")
    out = F.lit(TEMPLATES[template])
    for name in ("context", "query"):
        if "{" + name + "}" in TEMPLATES[template]:
            out = F.replace(out, F.lit("{" + name + "}"), values[name])
    return out
