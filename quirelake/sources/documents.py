"""Documents as sources: pages of a PDF's text structure as JSON, and word-processor files as they are."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import formula_flag, strip
from ..operators.layout import NUMBERED_HEADING, STYLES
from .formulas import linear_text, to_latex

LOADERS = {"pdf": "pdf", "docx": "docx", "doc": "docx"}
TEXT_DICT = "doc_id string, page_num int, width double, height double, blocks array<struct<type: int, bbox: array<double>, lines: array<struct<spans: array<struct<text: string, size: double, font: string>>>>>>"
BLOCKS = "doc_id string, page_num int, block_idx int, block_id string, content string, block_type string, style string, source string, has_formula boolean, confidence double"


def loader(filename: Column) -> Column:
    """Which loader a file name asks for; an error for any other suffix."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LOADERS.items() for x in kv])[suffix], F.raise_error(F.concat(F.lit("no loader for "), F.coalesce(filename, F.lit("null")))))


def read_text_dicts(spark: SparkSession, path: str) -> DataFrame:
    """Pages as JSON lines in the usual dictionary form of PDF text extraction."""
    return spark.read.schema(TEXT_DICT).json(path)


def pdf_blocks(pages: DataFrame) -> DataFrame:
    """A block per raw block: the text of all spans, the largest size, the first font; images without text; blank ones dropped."""
    spans = F.flatten(F.transform("b.lines", lambda line: line["spans"]))
    rows = pages.select("doc_id", "page_num", F.posexplode("blocks").alias("block_idx", "b")).withColumn("spans", F.coalesce(spans, F.array()))
    text = strip(F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    image = F.col("b.type") == 1
    box = F.struct(*[F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    out = rows.withColumn("content", F.when(image, "").otherwise(text)).where(image | (F.col("content") != ""))
    return out.select(
        "doc_id", "page_num", "block_idx", F.concat(F.lit("blk_"), F.substring(F.sha2(F.concat_ws(":", "doc_id", "page_num", "block_idx"), 256), 1, 12)).alias("block_id"), "content",
        F.when(image, "image").otherwise("text").alias("block_type"), box.alias("bbox"), F.col("block_idx").alias("reading_order"), F.array_max(F.transform("spans", lambda s: s["size"])).alias("max_font_size"),
        F.get("spans", F.lit(0))["font"].alias("font"), formula_flag(F.col("content")).alias("has_formula"),
    )


def page_texts(blocks: DataFrame) -> DataFrame:
    """The page's text: its blocks' contents, each ended by a line break."""
    lines = F.array_sort(F.collect_list(F.struct("block_idx", "content")))
    return blocks.groupBy("doc_id", "page_num").agg(lines.alias("l")).select("doc_id", "page_num", F.array_join(F.transform("l", lambda x: F.concat(x["content"], F.lit("\n"))), "").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_PICTURES = (_W + "drawing", _W + "pict", _W + "object")
_HEADING = re.compile(NUMBERED_HEADING)


def _paragraph(p: ET.Element, images: list[int]) -> tuple[str, bool]:
    """The paragraph's text in document order, pictures as placeholders, mathematics as LaTeX; whether it has mathematics."""
    parts, math = [], False
    stack: list[ET.Element] = list(reversed(list(p)))
    while stack:
        e = stack.pop()
        if e.tag == _M + "oMath":
            math = True
            latex = to_latex(e)
            parts.append(f"$${latex}$$" if latex else linear_text(e))
        elif e.tag == _W + "r" and any(x.tag in _PICTURES for x in e.iter()):
            images[0] += 1
            parts.append(f"[IMG_{images[0] - 1}]")
        elif e.tag == _W + "t":
            parts.append(e.text or "")
        elif e.tag == _W + "tab":
            parts.append("\t")
        elif e.tag not in (_W + "txbxContent",):
            stack.extend(reversed(list(e)))
    return "".join(parts), math


def docx_rows(doc_id: str, data: bytes) -> list[tuple]:
    """The blocks of one word-processor file: paragraphs, then text boxes, then tables; a file that can't be read has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
            styles = ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    names = {} if styles is None else {s.get(_W + "styleId"): s.find(_W + "name").get(_W + "val") for s in styles.iter(_W + "style") if s.find(_W + "name") is not None}
    names = {k: v[:1].upper() + v[1:] for k, v in names.items()}
    body, images, rows = root.find(_W + "body"), [0], []

    def add(text: str, kind: str, style: str | None, source: str | None, math: bool) -> None:
        rows.append((doc_id, 1, len(rows), f"blk_{doc_id}_{len(rows)}", text, kind, style, source, math, 1.0))

    for p in [] if body is None else body.findall(_W + "p"):
        text, math = _paragraph(p, images)
        text = text.strip()
        if not text:
            continue
        node = p.find(f"{_W}pPr/{_W}pStyle")
        style = names.get(node.get(_W + "val"), node.get(_W + "val")) if node is not None else "Normal"
        size = p.find(f"{_W}r/{_W}rPr/{_W}sz")
        points = float(size.get(_W + "val")) / 2 if size is not None else 0.0
        kind = "formula" if math else STYLES.get(style) or ("title" if points >= 18 else "section_heading" if points >= 14 or len(text) <= 60 and _HEADING.search(text) else "text")
        add(text, kind, style, None, math)
    for box in root.iter(_W + "txbxContent"):
        for p in box.iter(_W + "p"):
            text = _paragraph(p, images)[0].strip()
            if text:
                add(text, "text", None, "textbox", False)
    for t in [] if body is None else body.findall(_W + "tbl"):
        lines = [" | ".join("".join(x.text or "" for x in c.iter(_W + "t")).strip() for c in r.findall(_W + "tc")) for r in t.findall(_W + "tr")]
        if any(line.replace("|", "").strip() for line in lines):
            add("\n".join(lines), "table", "Table", None, False)
    return rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all word-processor files under ``path``; the document's id is the file's name up to the first underscore or dot."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for f in frames:
            rows = [r for doc, data in zip(f["doc_id"], f["content"], strict=True) for r in docx_rows(doc, bytes(data))]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,doc}").load(path)
    return files.select(F.regexp_extract("path", r"([^/_.]+)[^/]*$", 1).alias("doc_id"), "content").mapInPandas(work, BLOCKS)
