"""Tables in text: detection, parsing, rendering, continuation over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import has_text

TABLE_CATEGORIES = ("table", "table_caption", "table_content")


def table_regions(df: DataFrame, kind: str = "category") -> DataFrame:
    return df.where(F.lower(kind).isin(*TABLE_CATEGORIES))


def _edges(line):
    return F.regexp_replace(F.regexp_replace(line, r"^\|+", ""), r"\|+$", "")


def markdown_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``row_index``, ``cells``: the rows of texts of at least two lines that hold bars; row 0 is the header.

    A line of bars, dashes and blanks only is a separator; with colons it is data. All bars at both
    ends of a line fall away; cells beyond the header's width are dropped.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda s: strip(s)), lambda s: F.contains(s, F.lit("|")))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), lines.alias("lines")).where(F.size("lines") >= 2)
    data = F.filter("lines", lambda s: ~s.rlike(r"^[|\- ]+$"))
    cut = F.transform(data, lambda s: F.transform(F.split(_edges(s), r"\|"), lambda c: strip(c)))
    out = rows.select("id", F.posexplode(cut).alias("row_index", "cells"), F.size(F.element_at(cut, 1)).alias("width"))
    return out.select("id", "row_index", F.slice("cells", F.lit(1), F.col("width")).alias("cells"))


def cells(rows: DataFrame) -> DataFrame:
    """``id``, ``row_index``, ``col_index``, ``text``, ``is_header``."""
    return rows.select("id", "row_index", F.posexplode("cells").alias("col_index", "text"), (F.col("row_index") == 0).alias("is_header"))


def rendered(cell_rows: DataFrame, header_rows: int = 1) -> DataFrame:
    """``id``, ``markdown``: the grid of each table, missing cells empty, of several cells in a place the last one by ``cell_idx``
    (without that column, the largest text). Cells before the first row or column are left out."""
    place = F.struct("cell_idx", "text") if "cell_idx" in cell_rows.columns else F.col("text")
    cell_rows = cell_rows.where("row_index >= 0 and col_index >= 0")
    shape = cell_rows.groupBy("id").agg((F.max("row_index") + 1).alias("n_rows"), (F.max("col_index") + 1).alias("n_cols"))
    last = cell_rows.groupBy("id", "row_index", "col_index").agg(F.max_by("text", place).alias("text"))
    # a row's cells by column; gaps are filled from the table's width, without a join with a full grid
    row = last.groupBy("id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", "text"))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.col("m")[c], F.lit(""))), " | "), F.lit(" |"))
    rows = row.join(shape, "id").select("id", "row_index", "n_cols", line.alias("line"))
    bar = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols")), " | "), F.lit(" |"))
    with_bar = rows.select("id", F.col("row_index").cast("double").alias("at"), "line").unionByName(rows.where(F.col("row_index") == header_rows - 1).select("id", (F.col("row_index") + 0.5).alias("at"), bar.alias("line")))
    return with_bar.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("id", F.array_join(F.col("l.line"), "\n").alias("markdown"))


def text_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Recognised text as a table of one column: a row per line that isn't blank."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda s: strip(s)), lambda s: s != "")
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.posexplode(lines).alias("row_index", "text"))


def merged_over_pages(tables: DataFrame) -> DataFrame:
    """Tables joined with their continuation: doc_id, seq, table_id, n_rows, is_page_break.

    ``tables`` has doc_id, seq, table_id, n_rows, n_cols, header_rows. The next table continues one if it has as many columns, more
    than none, and no header. A table takes one continuation, so a run of them pairs up.
    """
    rows = _continued(tables)
    out = rows.groupBy("doc_id", "run", "pair").agg(F.min("seq").alias("seq"), F.min_by("table_id", "seq").alias("table_id"), F.sum("n_rows").cast("int").alias("n_rows"), (F.count("*") > 1).alias("is_page_break"))
    return out.select("doc_id", "seq", "table_id", "n_rows", "is_page_break")


def _continued(tables: DataFrame) -> DataFrame:
    """``tables`` with ``run`` and ``pair``: a table and the one that continues it share both."""
    line = W.partitionBy("doc_id").orderBy("seq")
    joins = (F.col("header_rows") == 0) & (F.col("n_cols") > 0) & (F.col("n_cols") == F.lag("n_cols").over(line))
    rows = tables.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(line))
    place = F.row_number().over(W.partitionBy("doc_id", "run").orderBy("seq")) - 1
    return rows.withColumn("pair", F.floor(place / 2))


def merged_cells(tables: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """The cells of the merged tables: those of a continuation under its head's id, below the head's rows.

    ``tables`` as for ``merged_over_pages``, ``cell_rows``: table_id, cell_idx, row_index, col_index, text, is_header.
    """
    pair = W.partitionBy("doc_id", "run", "pair").orderBy("seq")
    own = _continued(tables).select(
        "table_id", F.first("table_id").over(pair).alias("head"), F.coalesce(F.lag("n_rows").over(pair), F.lit(0)).alias("offset"), (F.row_number().over(pair) - 1).alias("part")
    )
    rows = cell_rows.join(own, "table_id")
    return rows.select(F.col("head").alias("table_id"), "part", "cell_idx", (F.col("row_index") + F.col("offset")).alias("row_index"), "col_index", "text", "is_header")


def table_objects(elements: DataFrame, page_num: int = 0) -> DataFrame:
    """Tables still without cells, from the elements that are tables themselves, on the given page."""
    rows = elements.where(F.lower("category") == "table")
    return rows.select("doc_id", "element_idx", F.lit(page_num).alias("page_num"), "bbox", F.lit(0).alias("num_rows"), F.lit(0).alias("num_cols"), F.lit(1).alias("header_rows"))


def recovered(blocks: DataFrame, elements: DataFrame, answers: DataFrame, least: int = 30) -> DataFrame:
    """``blocks`` and, at the end of each page, a table block for each table element without text whose image was recognised.

    ``elements``: doc_id, page_num, element_idx, category, confidence, bbox; ``answers``: doc_id, page_num, element_idx, markdown. Null, blank and refusing
    (NOT_A_TABLE) answers add nothing; a region that more than ``least`` characters of text blocks overlap is left alone.
    """
    good = answers.where(F.length(strip(F.coalesce("markdown", F.lit("")))) > 0).where(~F.contains(F.upper("markdown"), F.lit("NOT_A_TABLE")))
    asked = table_regions(elements).where("bbox is not null").select("doc_id", "page_num", "element_idx", F.concat_ws("/", "doc_id", "page_num", "element_idx").alias("region_id"), F.col("bbox").alias("region"), "confidence")
    free = asked.join(has_text(asked, blocks, least).where("not has_text").select("region_id"), "region_id")
    last = blocks.groupBy("doc_id", "page_num").agg(F.max("block_idx").alias("last"))
    place = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("element_idx"))
    more = free.join(good, ["doc_id", "page_num", "element_idx"]).join(last, ["doc_id", "page_num"], "left")
    more = more.select(
        "doc_id", "page_num", (F.coalesce("last", F.lit(-1)) + place).cast("int").alias("block_idx"), strip(F.col("markdown")).alias("content"), F.lit("table").alias("block_type"), F.col("region").alias("bbox"),
        F.col("element_idx").cast("int").alias("reading_order"), "confidence", F.lit("table_recovery").alias("source"),
    )
    return blocks.unionByName(more, allowMissingColumns=True)
