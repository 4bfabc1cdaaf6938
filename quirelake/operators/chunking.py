"""Structure-aware chunks: cut at headings, tables, formulas, figures and numbered questions; joined where too little stands alone.

What the buffer of a sequential chunker would hold is a group here: a running sum of boundary
flags numbers the groups of a page, a fold over a group's texts cuts what grows too long, and the
two merging steps are runs of neighbours in the document's order. A document's rows meet in one
window partition; documents are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE, rfind, strip

HEADINGS = ("title", "heading", "section_heading")
STANDALONE = ("table", "formula", "figure")
#: Headings too short to stand alone, and what begins a question or a row of options.
SHORT_HEADINGS = ("填空题", "判断题", "选择题", "解答题", "计算题", "证明题")
QUESTION = r"^(\p{Nd}+[．.、]|[（(]\p{Nd}+[）)]|[①②③④⑤⑥⑦⑧⑨⑩]|[一二三四五六七八九十]+[、．])"
OPTIONS_ONLY = r"^([A-Da-d][．.、]|\[IMG_\p{Nd}+\][；;]" + SPACE + r"*[B-Db-d][．.、])"
INLINE = SPACE + r"{2,}(?=\p{Nd}+[．.、])"
LONG_ENOUGH, STUB = 40, 10


def question(text: Column) -> Column:
    """Whether a text begins a numbered question and isn't a row of options."""
    return text.rlike(QUESTION) & ~text.rlike(OPTIONS_ONLY)


def inline_questions(text: Column) -> Column:
    """The parts of a stripped text in which several numbered questions stand side by side."""
    return F.filter(F.transform(F.when(F.length(text) > LONG_ENOUGH, F.split(text, INLINE)).otherwise(F.array(text)), lambda s: strip(s)), lambda s: s != "")


def units(blocks: DataFrame) -> DataFrame:
    """The blocks' parts in order: doc_id, page_num, block_idx, sub, kind (heading, short, alone, text), text, block_type, bbox."""
    content = F.coalesce("content", F.lit(""))
    kind = F.when(F.col("block_type").isin(*HEADINGS), F.when(strip(content).isin(*SHORT_HEADINGS), "short").otherwise("heading")).when(F.col("block_type").isin(*STANDALONE), "alone").otherwise("text")
    parts = F.when(F.col("kind") == "text", inline_questions(strip(content))).when(F.col("kind") == "alone", F.array(content)).otherwise(F.array(strip(content)))
    rows = blocks.withColumn("kind", kind).withColumn("raw", content).withColumn("parts", parts)
    return rows.select("doc_id", "page_num", "block_idx", "block_id", "kind", "block_type", "bbox", "raw", F.posexplode("parts").alias("sub", "text"))


def _levels(buffer: Column, limit: int) -> Column:
    head = F.substring(buffer, 1, limit)
    line = rfind(head, "\n") > limit // 2
    mark = F.greatest(*[rfind(head, m) for m in "。！？"]) > limit // 2
    return F.when((F.length(buffer) > limit) & ~line & mark, "sentence").otherwise("paragraph")


def folded(first: Column, texts: Column, limit: int, overlap: int) -> Column:
    """The chunks of one group: its texts one under the other, cut once at ``limit`` whenever an added text reaches it."""

    def add(acc: Column, text: Column) -> Column:
        buffer = F.concat(acc["buffer"], text, F.lit("\n"))
        piece = F.struct(strip(F.substring(buffer, 1, limit)).alias("text"), _levels(buffer, limit).alias("level"))
        full = F.length(buffer) >= limit
        return F.struct(F.when(full, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"), F.when(full, F.substring(buffer, limit - overlap + 1, 1 << 30)).otherwise(buffer).alias("buffer"))

    start = F.struct(F.from_json(F.lit("[]"), "array<struct<text: string, level: string>>").alias("out"), first.alias("buffer"))

    def end(acc: Column) -> Column:
        rest = F.struct(strip(acc["buffer"]).alias("text"), F.lit("paragraph").alias("level"))
        return F.when(strip(acc["buffer"]) != "", F.concat(acc["out"], F.array(rest))).otherwise(acc["out"])

    return F.aggregate(texts, start, add, end)


def raw_chunks(blocks: DataFrame, limit: int = 2500, overlap: int = 128) -> DataFrame:
    """Chunks before merging: doc_id, seq, content, page_num, section, chunk_type, bbox, layout_tree_path, chunk_level."""
    page, line = W.partitionBy("doc_id", "page_num"), W.partitionBy("doc_id", "page_num").orderBy("block_idx", "sub")
    u = units(blocks)
    before = F.lag("kind").over(line)
    blank = (before == "heading") & (F.lag("text").over(line) == "")  # nothing is held yet that a question could end
    earlier = F.lag("kind", 2).over(line)
    fresh = earlier.isNull() | (earlier == "alone") | ((earlier == "heading") & (F.lag("text", 2).over(line) == ""))
    lone = (before == "short") | ((before == "text") & F.lag("text").over(line).isin(*SHORT_HEADINGS) & fresh)  # a short heading is all that is held
    starts = F.col("kind").isin("heading", "short", "alone") | (before == "alone") | (question(F.col("text")) & ~lone & ~blank)
    u = u.withColumn("grp", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(line))
    name = F.when(F.col("kind") == "short", F.col("text")).when(F.col("kind") == "heading", F.substring("raw", 1, 60))
    u = u.withColumn("name", name).withColumn("own_section", F.last("name", ignorenulls=True).over(line)).withColumn("heads", F.count("name").over(line))
    is_text = F.col("kind") == "text"
    item = F.struct("block_idx", "sub", F.col("text").alias("t"))
    g = u.groupBy("doc_id", "page_num", "grp").agg(
        F.min_by("kind", F.struct("block_idx", "sub")).alias("kind"),
        F.min_by("text", F.struct("block_idx", "sub")).alias("first"),
        F.min_by("block_type", F.struct("block_idx", "sub")).alias("block_type"),
        F.min_by("bbox", F.struct("block_idx", "sub")).alias("bbox"),
        F.max_by("own_section", F.struct("block_idx", "sub")).alias("own_section"),
        F.max("heads").alias("heads"),
        F.max("name").alias("name"),  # only a group's first unit has one
        F.array_sort(F.collect_list(F.when(is_text, item))).alias("texts"),
        F.max(F.when(F.col("name").isNotNull(), F.struct("block_idx", F.substring("raw", 1, 60).alias("n")))).alias("last_heading"),
    )
    # by page: its headings, gathered once, of which a group has the first so many as its path, and the heading that the next page begins with
    heading = F.when(F.col("name").isNotNull(), F.struct("grp", "name"))
    pages = g.groupBy("doc_id", "page_num").agg(F.max("last_heading").alias("h"), F.array_sort(F.collect_list(heading)).alias("names"))
    default = F.coalesce(F.last(F.col("h.n"), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("page_num").rowsBetween(W.unboundedPreceding, -1)), F.lit(""))
    path = F.slice(F.col("names.name"), F.lit(1), F.col("heads").cast("int"))
    g = g.drop("name").join(pages.select("doc_id", "page_num", "names", default.alias("default")), ["doc_id", "page_num"]).withColumn("path", path)
    start = F.when(F.col("kind") == "text", "").otherwise(F.concat("first", F.lit("\n")))
    alone = F.array(F.struct(F.col("first").alias("text"), F.lit("paragraph").alias("level")))
    pieces = F.when(F.col("kind") == "alone", alone).otherwise(folded(start, F.transform("texts", lambda t: t["t"]), limit, overlap))
    out = g.select("doc_id", "page_num", "grp", F.coalesce("own_section", "default").alias("section"), F.when(F.col("kind") == "alone", F.col("block_type")).otherwise("text").alias("chunk_type"), "bbox", "path", F.posexplode(pieces).alias("k", "p"))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "grp", "k")).cast("int")
    # only what was flushed first keeps the box of the group's first block
    box = F.when((F.col("k") == 0), F.col("bbox"))
    return out.select("doc_id", seq.alias("seq"), F.col("p.text").alias("content"), "page_num", "section", "chunk_type", box.alias("bbox"), F.col("path").alias("layout_tree_path"), F.col("p.level").alias("chunk_level"))


_META = ("page_num", "section", "chunk_type", "bbox", "layout_tree_path", "chunk_level")


def options_merged(chunks: DataFrame) -> DataFrame:
    """Chunks that are only rows of options, joined by a blank to the chunk before. One keeps that chunk's metadata, several take the last but one's."""
    line = W.partitionBy("doc_id").orderBy("seq")
    orphan = (F.col("chunk_type") == "text") & F.substring_index("content", "\n", 1).rlike(OPTIONS_ONLY) & (F.row_number().over(line) > 1)
    runs = chunks.withColumn("orphan", orphan).withColumn("run", F.sum(F.when(F.col("orphan"), 0).otherwise(1)).over(line))
    listed = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "content", F.struct(*_META).alias("m")))).alias("l"))
    meta = F.element_at("l", F.greatest(F.lit(1), F.size("l") - 1))["m"]
    out = listed.select("doc_id", F.col("l")[0]["seq"].alias("seq"), F.array_join(F.transform("l", lambda x: x["content"]), " ").alias("content"), meta.alias("m"))
    return out.select("doc_id", "seq", "content", *[F.col(f"m.{c}") for c in _META])


def stubs_merged(chunks: DataFrame) -> DataFrame:
    """Chunks of at most ten characters, set before the next chunk; of a run of them every second one takes the one before.

    The last chunk of a document stays. An empty chunk that would wait is dropped, and nothing
    after it in the document is merged. A document of one chunk is left alone.
    """
    line = W.partitionBy("doc_id").orderBy("seq")
    doc = W.partitionBy("doc_id")
    short = strip(F.col("content"))
    rows = chunks.withColumn("short", short).withColumn("stub", F.length("short") <= STUB)
    rows = rows.withColumn("n", F.row_number().over(line)).withColumn("all", F.count("*").over(doc)).withColumn("run", F.sum(F.when(F.col("stub"), 0).otherwise(1)).over(line))
    place = F.row_number().over(W.partitionBy("doc_id", "run", "stub").orderBy("seq"))
    rows = rows.withColumn("waits", F.col("stub") & (place % 2 == 1) & (F.col("all") > 1))
    rows = rows.withColumn("dead", F.min(F.when(F.col("waits") & (F.col("short") == ""), F.col("n"))).over(doc)).withColumn("live", F.col("dead").isNull() | (F.col("n") < F.col("dead")))
    before = F.when(F.lag(F.col("waits") & F.col("live")).over(line), F.lag("short").over(line))
    rows = rows.withColumn("before", F.when(F.col("live") & ~F.col("waits"), before))
    gone = (F.col("n") == F.coalesce("dead", F.lit(-1))) | (F.col("live") & F.col("waits") & (F.col("n") < F.col("all")))
    return rows.where(~gone).select("doc_id", "seq", F.when(F.col("before").isNotNull(), F.concat_ws("\n", "before", "content")).otherwise(F.col("content")).alias("content"), *_META)


def chunk_documents(blocks: DataFrame, limit: int = 2500, overlap: int = 128) -> DataFrame:
    """The chunks of every document: chunk_id, doc_id, chunk_seq, content and metadata's columns; ids from document and place."""
    out = stubs_merged(options_merged(raw_chunks(blocks, limit, overlap)))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("seq")).cast("int")
    rows = out.withColumn("chunk_seq", seq)
    name = F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_seq").cast("string")), 256), 1, 12))
    return rows.select(name.alias("chunk_id"), "doc_id", "chunk_seq", "content", *_META)
