"""Layout: labels, block classes, columns, reading order, the heading tree, boxes, recognisers' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rfind, strip

#: Label of a layout model to category; any other label is text.
CATEGORIES = {
    "doc_title": "title", "paragraph_title": "section_heading", "image": "figure", "chart": "figure", "seal": "figure", "figure_title": "figure_caption", "table": "table", "header": "header", "header_image": "header",
    "footer": "footer", "footer_image": "footer", "footnote": "footer", "vision_footnote": "footer", "display_formula": "formula", "inline_formula": "formula", "formula_number": "formula", "reference": "reference", "reference_content": "reference",
}
HEADINGS = ("title", "section_heading", "heading", "h1", "h2", "h3")
#: Paragraph style to block type.
STYLES = {
    "Heading 1": "title", "Title": "title", "1": "title", "Heading 2": "section_heading", "Heading 3": "section_heading", "Heading 4": "section_heading", "Heading 5": "section_heading", "Heading 6": "section_heading",
    "Subtitle": "section_heading", "2": "section_heading", "3": "section_heading",
}
NUMBERED_HEADING = r"^(第[一二三四五六七八九十百\d]+[章节]|\d+(\.\d+)+|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)]|.{1,8}题$)"


def category(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[label], F.lit("text"))


def block_class(size: Column, text: Column) -> Column:
    """The class of a block by the prefix of a caption, else by the font size of its lines."""
    low = F.lower(strip(text))
    return (
        F.when(F.startswith(low, F.lit("table ")) | F.startswith(low, F.lit("表 ")), "table_caption")
        .when(F.startswith(low, F.lit("figure ")) | F.startswith(low, F.lit("图 ")), "figure_caption")
        .when(size >= 18, "title")
        .when(size >= 12, "section_heading")
        .otherwise("text")
    )


def styled_type(style: Column, size: Column, text: Column) -> Column:
    """The type of a word-processor paragraph: by style, font size, or a short text's numbering."""
    named = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])[style]
    return F.coalesce(named, F.when(size >= 18, "title").when(size >= 14, "section_heading"), F.when((F.length(text) <= 60) & text.rlike(NUMBERED_HEADING), "section_heading"), F.lit("text"))


PAGE_WIDTH = 595.0


def _halves(width: Column) -> tuple[Column, Column]:
    """The ends of the gap in the middle of a page."""
    return width / 2 - 0.08 * width, width / 2 + 0.08 * width


def two_columns(boxes: DataFrame) -> DataFrame:
    """``doc_id``, ``page_num``, ``two_columns``: of the text boxes beside the page's middle gap, at least three, a quarter or more stand on either side.

    ``boxes`` has doc_id, page_num, bbox, width (of the page; null is 595) and image; images and rows without a box don't count, a page of width 0 has one column.
    """
    width = F.coalesce("width", F.lit(PAGE_WIDTH))
    low, high = _halves(width)
    on_left = F.col("bbox.x1") <= low
    text = ~F.col("image") & F.col("bbox").isNotNull() & (width != 0)
    left, right = F.count_if(text & on_left), F.count_if(text & ~on_left & (F.col("bbox.x0") >= high))
    return boxes.groupBy("doc_id", "page_num").agg(((left + right >= 3) & (4 * left >= left + right) & (4 * right >= left + right)).alias("two_columns"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """``order`` from 0: by the upper edge; on pages of two columns, of equal edges what isn't in the right column first; then as given.

    ``boxes`` as for ``two_columns``, with block_idx and block_id. In the right column is text that starts beyond the gap; images never are.
    """
    low, high = _halves(F.coalesce("width", F.lit(PAGE_WIDTH)))
    right = F.col("two_columns") & ~F.col("image") & ~(F.col("bbox.x1") < low) & (F.col("bbox.x0") > high)
    line = W.partitionBy("doc_id", "page_num").orderBy("bbox.y0", "side", "block_idx", "block_id")
    rows = boxes.where("bbox is not null").join(two_columns(boxes), ["doc_id", "page_num"]).withColumn("side", right.cast("int"))
    return rows.withColumn("order", (F.row_number().over(line) - 1).cast("int"))


def raw_elements(pages: DataFrame) -> DataFrame:
    """Layout elements of pages in the dictionary form of PDF text extraction, without any model: doc_id, page_num, element_idx, category, confidence, text, bbox.

    Lines without text don't count; a line's size is its first span's, 11 where none is given, a block's the largest. Blocks without text are left out,
    images are figures. ``element_idx`` is the reading order.
    """
    spans = lambda line: F.coalesce(line["spans"], F.array())
    line = lambda x: F.struct(F.array_join(F.transform(spans(x), lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("t"), F.coalesce(F.get(spans(x), F.lit(0))["size"], F.lit(11.0)).alias("size"))
    rows = pages.select("doc_id", "page_num", "width", F.posexplode("blocks").alias("block_idx", "b")).withColumn("image", F.coalesce(F.col("b.type"), F.lit(0)) == 1)
    rows = rows.withColumn("lines", F.filter(F.transform(F.coalesce("b.lines", F.array()), line), lambda x: strip(x["t"]) != "")).where(F.col("image") | (F.size("lines") > 0))
    box = F.struct(*[F.coalesce(F.get("b.bbox", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    text = F.array_join(F.transform("lines", lambda x: x["t"]), "")
    rows = rows.withColumn("bbox", box).withColumn("text", F.when(F.col("image"), "").otherwise(text)).withColumn("size", F.array_max(F.transform("lines", lambda x: x["size"])))
    rows = rows.withColumn("block_id", F.lit("")).withColumn("category", F.when(F.col("image"), "figure").otherwise(block_class(F.col("size"), F.col("text"))))
    return reading_order(rows).select("doc_id", "page_num", F.col("order").alias("element_idx"), "category", F.when(F.col("image"), 0.9).otherwise(0.85).alias("confidence"), strip(F.col("text")).alias("text"), "bbox")


def analysed(model: DataFrame, raw: DataFrame, word: DataFrame) -> DataFrame:
    """The elements of each page from the first source that has any: a layout model's, those of the raw text dictionary, those of word-processor blocks."""
    names = ("doc_id", "page_num", "element_idx", "category", "confidence", "text", "bbox")
    out, seen = None, None
    for source, df in (("model", model), ("raw", raw), ("word", word)):
        rows = df.select(*names, F.lit(source).alias("source"))
        rows = rows if seen is None else rows.join(seen, ["doc_id", "page_num"], "left_anti")
        own = rows.select("doc_id", "page_num").distinct()
        out, seen = (rows, own) if out is None else (out.unionByName(rows), seen.unionByName(own))
    return out


def layout_tree(elements: DataFrame) -> DataFrame:
    """``parent_idx`` of each element: the nearest heading before it or of its own place, null for headings and for what stands before the first.

    ``elements`` has doc_id, element_idx, category, text; those without a place come last. The text is cut to 120 characters.
    """
    line = W.partitionBy("doc_id").orderBy(F.asc_nulls_last("element_idx")).rangeBetween(W.unboundedPreceding, W.currentRow)
    heading = F.lower("category").isin(*HEADINGS)
    above = F.last(F.when(heading, F.col("element_idx")), ignorenulls=True).over(line)
    return elements.withColumn("parent_idx", F.when(~F.coalesce(heading, F.lit(False)), above)).withColumn("text", F.substring("text", 1, 120))


def tree_lines(tree: DataFrame) -> DataFrame:
    """The tree as text: a line an element, indented below its heading."""
    depth = F.when(F.col("parent_idx").isNull(), 0).otherwise(1)
    return tree.select("doc_id", "element_idx", F.concat(F.repeat(F.lit("  "), depth), F.lit("["), F.coalesce("category", F.lit("")), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("line"))


def tree_paths(tree: DataFrame) -> DataFrame:
    """``doc_id``, ``element_idx``, ``path``: each node's own label; the root's is the word root."""
    return tree.select("doc_id", "element_idx", F.array(F.coalesce("category", F.lit(""))).alias("path"))


def tree_sizes(tree: DataFrame) -> DataFrame:
    return tree.where("parent_idx is not null").groupBy("doc_id", "parent_idx").agg(F.count("*").alias("children"))


def area(b: str) -> Column:
    return (F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0"))


def overlap_area(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def touching(a: str, b: str) -> Column:
    """Whether two boxes overlap or touch; false without a box."""
    apart = (F.col(f"{a}.x1") < F.col(f"{b}.x0")) | (F.col(f"{b}.x1") < F.col(f"{a}.x0")) | (F.col(f"{a}.y1") < F.col(f"{b}.y0")) | (F.col(f"{b}.y1") < F.col(f"{a}.y0"))
    return F.coalesce(~apart, F.lit(False))


def neighbours(boxes: DataFrame, reach: int = 1) -> DataFrame:
    """Pairs of boxes of a page whose places in the page's order are at most ``reach`` apart: a,b with their boxes.

    An equi-join on page and place, so a page of any length costs its own length times ``reach``.
    """
    line = W.partitionBy("doc_id", "page_num").orderBy("block_idx", "block_id")
    rows = boxes.where("bbox is not null").select("doc_id", "page_num", "block_id", "bbox", F.row_number().over(line).alias("place"))
    a = rows.select("doc_id", "page_num", F.col("block_id").alias("id_a"), F.col("bbox").alias("a"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + reach)).alias("place"))
    b = rows.select("doc_id", "page_num", "place", F.col("block_id").alias("id_b"), F.col("bbox").alias("b"))
    return a.join(b, ["doc_id", "page_num", "place"])


def has_text(regions: DataFrame, blocks: DataFrame, least: int = 30) -> DataFrame:
    """``region_id``, ``chars``, ``has_text``: whether more than ``least`` characters of text blocks overlap the region; joined by page first."""
    joined = regions.select("doc_id", "page_num", "region_id", "region").join(blocks.where("block_type = 'text' and bbox is not null").select("doc_id", "page_num", "bbox", "content"), ["doc_id", "page_num"])
    chars = joined.where(touching("region", "bbox")).groupBy("region_id").agg(F.sum(F.length("content")).alias("chars"))
    out = regions.select("region_id").distinct().join(chars, "region_id", "left")
    return out.select("region_id", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"), (F.coalesce("chars", F.lit(0)) > least).alias("has_text"))


def page_confidence(text: Column) -> Column:
    """A recognised page's confidence by its length."""
    return F.least(F.lit(0.95), 0.5 + F.length(text) / 2000)


def _unfenced(text: Column) -> Column:
    """A recogniser's answer without the line of its opening and of its closing code fence."""
    fence, out = F.lit("```"), strip(text)
    out = F.when(F.startswith(out, fence), F.when(F.contains(out, F.lit("\n")), F.substring(out, F.locate("\n", out) + 1, F.length(out))).otherwise(F.substring(out, F.lit(4), F.length(out)))).otherwise(out)
    tail = F.when(F.contains(out, F.lit("\n")), F.substring(out, F.lit(1), rfind(out, "\n"))).otherwise(F.substring(out, F.lit(1), F.greatest(F.length(out) - 3, F.lit(0))))
    return F.when(F.endswith(out, fence), tail).otherwise(out)


def cleaned_formula(text: Column) -> Column:
    """A recognised formula without the code fences around it; what stands inside stays. Null is empty."""
    out = _unfenced(F.coalesce(text, F.lit("")))
    return F.when(out == "``````", "").otherwise(strip(out))


def formula_confidence(text: Column) -> Column:
    """0.85 for an answer that begins as displayed mathematics, 0.7 for another one, 0 for none."""
    out = _unfenced(F.coalesce(text, F.lit("")))
    return F.when(out.isin("", "``````"), 0.0).when(F.startswith(out, F.lit("$$")), 0.85).otherwise(0.7)


def wrapped_formula(latex: Column) -> Column:
    """A model's LaTeX as displayed mathematics and its confidence: struct(latex, confidence); empty and 0 for nothing."""
    body = strip(F.coalesce(latex, F.lit("")))
    wrapped = F.when(F.startswith(body, F.lit("$$")), body).otherwise(F.concat(F.lit("$$"), body, F.lit("$$")))
    return F.struct(F.when(body == "", "").otherwise(wrapped).alias("latex"), F.when(body == "", 0.0).otherwise(0.85).alias("confidence"))


#: How image files begin.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp"}


def mime_type(head: Column) -> Column:
    """The type of an image by its first bytes; PNG, if they are none of the known."""
    h = F.hex(F.substring(head, 1, 8))
    return F.coalesce(*[F.when(F.startswith(h, F.lit(m)), kind) for m, kind in MAGIC.items()], F.lit("image/png"))


def image_scale(width: Column, least: int = 600) -> Column:
    """By how much a formula's image is enlarged; a width below 1 counts as 1."""
    return F.when(width < least, F.greatest(F.lit(2), F.floor(least / F.greatest(width, F.lit(1))) + 1)).otherwise(1).cast("int")


def capped_size(width: Column, height: Column, most: int = 1024) -> Column:
    """The size of an image after its longest edge is brought down to ``most``: struct(width, height)."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, most / longest).otherwise(1.0)
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def layout_elements(blocks: DataFrame) -> DataFrame:
    """Word-processor blocks as layout elements."""
    kinds = F.create_map(*[F.lit(x) for kv in {"heading": "section_heading", "image": "figure", "unknown": "text"}.items() for x in kv])
    known = F.coalesce(F.col("block_type"), F.lit("text"))
    return blocks.select("doc_id", "page_num", "block_id", F.coalesce(kinds[known], known).alias("category"), F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.85)).alias("confidence"), F.substring("content", 1, 200).alias("text"))
