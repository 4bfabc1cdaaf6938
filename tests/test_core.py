"""The engine's operators on small cases, and against sequential models."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import chunking, confidence, index, layout, retrieval, review
from quirelake.operators import tables as tab
from quirelake.plans.components import components
from quirelake.sources import documents as src
from quirelake.sources.formulas import to_latex

BLOCK = "doc_id string, page_num int, block_idx int, block_id string, content string, block_type string, bbox struct<x0: double, y0: double, x1: double, y1: double>"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scalars(spark):
    df = spark.createDataFrame([("　 a b　",), ("x.y.z",), ("",), (None,)], "s string")
    assert [r.v for r in df.select(T.strip(F.col("s")).alias("v")).collect()] == ["a b", "x.y.z", "", None]
    assert [r.v for r in df.select(T.rfind(F.col("s"), ".").alias("v")).collect()][:3] == [-1, 3, -1]
    assert spark.createDataFrame([("Ab 图 c第",)], "s string").select(T.tokens(F.col("s")).alias("v")).first().v == ["ab", "图", "c", "第"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in parent}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, None), (5, "")], "id int, text string")
    ix = index.keyword_index(docs, "id", "text")
    asked = spark.createDataFrame([(1, "apple pie"), (2, "unknownword"), (3, "  ")], "query_id int, query string")
    got = index.keyword_search(ix, asked, 2).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (1, 2)]
    assert index.keyword_search(ix, asked, 5, allowed=spark.createDataFrame([(2,)], "id int")).count() == 1
    assert index.keyword_search(index.keyword_index(docs.limit(0), "id", "text"), asked).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("q", x, i) for i, x in enumerate("abc", 1)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", x, i) for i, x in enumerate("bda", 1)], "query_id string, id string, rank int")
    got = index.fused(a, b).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "d", "c"] and got[0].score == round(1 / 61 + 1 / 62, 6)


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], "id string, v array<float>")
    u = index.unit_vectors(v, "id", "v")
    got = index.vector_search(u, u.where("id = 'a'").withColumnRenamed("id", "query_id")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("b", 0.6)]


def test_packing_and_truncation(spark):
    r = spark.createDataFrame([("q", i, i, "x" * 20, None) for i in range(1, 6)] + [("r", 1, 9, "句子A。" * 200, None)], "query_id string, rank int, id int, content string, metadata struct<source_file: string, page_num: int, section: string, chunk_type: string>")
    got = retrieval.packed_context(r, 50).collect()
    assert sorted(x.id for x in got if x.query_id == "q") == [1, 2, 3, 4]
    long = next(x.block for x in got if x.query_id == "r")
    assert long.endswith(retrieval.CUT_MARK) and len(long) < 120 and long[: -len(retrieval.CUT_MARK)].endswith("。")


def test_decision_and_routes(spark):
    df = spark.createDataFrame([(0.75, "x"), (0.4, "x"), (0.39, "x")], "c double, p string").withColumn("decision", retrieval.decision(F.col("c")))
    got = retrieval.routed(df, ["p"]).orderBy(F.desc("c")).collect()
    assert [(x.decision, x.p, x.needs_review) for x in got] == [("accept", "x", False), ("review", "x", True), ("reject", None, False)]
    with pytest.raises(ValueError):
        retrieval.decision(F.lit(1), 0.4, 0.5)
    with pytest.raises(Exception):
        retrieval.routed(spark.createDataFrame([("perhaps",)], "decision string"), []).collect()


def test_confidence(spark):
    d = spark.createDataFrame([("a",)], "doc_id string")
    one = lambda n, v: spark.createDataFrame([("a", v)], f"doc_id string, {n} double")
    got = confidence.document_confidence(d, layout_quality=one("layout_quality", 0.8), ocr_confidence=one("ocr_confidence", 0.9), table_integrity=one("table_integrity", 1.0), chunk_coherence=one("chunk_coherence", 1.0), reranker_score=one("reranker_score", 0.85))
    assert got.first().overall == 0.90


def test_boxes(spark):
    s = "struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 30.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 15.0, 10.0))], f"a {s}, b {s}")
    got = df.select(layout.iou("a", "b").alias("i"), layout.touching("a", "b").alias("t")).collect()
    assert [round(x.i, 4) for x in got] == [0, 1, 0.3333, 0] and [x.t for x in got] == [False, True, True, True]


def test_layout_classes_and_tree(spark):
    df = spark.createDataFrame([(10.0, "Table 2: Results"), (10.0, "表 1：实验数据"), (18.0, "a"), (14.0, "a"), (12.0, "a"), (11.0, "a")], "z double, t string")
    assert [r.c for r in df.select(layout.block_class(F.col("z"), F.col("t")).alias("c")).collect()] == ["table_caption", "table_caption", "title", "section_heading", "section_heading", "text"]
    e = spark.createDataFrame([("d", i, c, "t") for i, c in enumerate(["text", "title", "text", "title", "text", "table"])], "doc_id string, element_idx int, category string, text string")
    assert [r.parent_idx for r in layout.layout_tree(e).orderBy("element_idx").collect()] == [None, None, 1, None, 3, 3]


def test_tables(spark):
    md = "| a | b |\n| --- | --- |\n| 1 | 2 | 3 |\n| :---: | x |"
    r = tab.markdown_rows(spark.createDataFrame([("t", md), ("u", "plain"), ("v", None), ("w", "")], "id string, s string"), "id", "s")
    assert rows(r, "row_index", "cells") == [(0, ["a", "b"]), (1, ["1", "2"]), (2, [":---:", "x"])]
    assert tab.rendered(tab.cells(r)).first().markdown == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| :---: | x |"
    t = spark.createDataFrame([("d", 1, "x", 10, 3, 1), ("d", 2, "y", 5, 3, 0), ("d", 3, "z", 5, 3, 0)], "doc_id string, seq int, table_id string, n_rows int, n_cols int, header_rows int")
    assert rows(tab.merged_over_pages(t), "table_id", "n_rows", "is_page_break") == [("x", 15, True), ("z", 5, False)]


def test_review(spark):
    f = spark.createDataFrame([(1, "t", "approve", None, None, [("b1", "new", None)]), (2, "t", "reject", " ", "f", []), (3, "u", "reject", "bad", "f", None)], "seq int, task_id string, action string, reason string, filename string, edited_blocks array<struct<block_id: string, new_content: string, block_type: string>>")
    got = review.feedback_totals(f).first()
    assert (got.total_actions, got.approved, got.rejected, got.with_edits, got.approval_rate) == (3, 1, 2, 1, 0.333)
    assert rows(review.feedback_block_types(f), "block_type", "edits") == [("unknown", 1)]
    t = spark.createDataFrame([("t", "review", True), ("u", "review", True), ("v", "review", True)], "task_id string, status string, needs_review boolean")
    assert rows(review.transitions(t, f), "task_id", "status", "needs_review") == [("t", "accepted", False), ("u", "rejected", False), ("v", "review", True)]
    assert rows(review.queue_positions(spark.createDataFrame([("a", 9000, "queued"), ("b", 1, "queued"), ("c", 2, "x")], "task_id string, seq int, status string")), "task_id", "position") == [("a", 2), ("b", 1)]


# chunks: a sequential model of the rules


def model_chunks(blocks, limit, overlap):
    q, o = re.compile(r"^(\d+[．.、]|[（(]\d+[）)]|[①-⑩]|[一二三四五六七八九十]+[、．])"), re.compile(r"^([A-Da-d][．.、]|\[IMG_\d+\][；;]\s*[B-Db-d][．.、])")
    out, default = [], ""
    for page in sorted({b[1] for b in blocks}):
        buf, box, sec, path = "", None, default, []

        def flush(page=page):
            nonlocal buf, box
            if buf.strip():
                out.append([buf.strip(), page, sec, "text", box, list(path), "paragraph"])
            buf, box = "", None

        for _, p, _, _, content, kind, bb in blocks:
            if p != page:
                continue
            content = content or ""
            if kind in chunking.HEADINGS:
                h = content.strip()
                flush()
                sec = h if h in chunking.SHORT_HEADINGS else content[:60]
                path.append(sec)
                buf, box = h + "\n", bb
            elif kind in chunking.STANDALONE:
                flush()
                out.append([content, page, sec, kind, bb, list(path), "paragraph"])
            else:
                text = content.strip()
                for s in (x.strip() for x in (re.split(r"\s{2,}(?=\d+[．.、])", text) if len(text) > 40 else [text])):
                    if not s:
                        continue
                    if q.match(s) and not o.match(s) and buf.strip() and buf.strip() not in chunking.SHORT_HEADINGS:
                        flush()
                    if not buf:
                        box = bb
                    buf += s + "\n"
                    if len(buf) >= limit:
                        head, level = buf[:limit], "paragraph"
                        if len(buf) > limit and head.rfind("\n") <= limit // 2 and max(head.rfind(m) for m in "。！？") > limit // 2:
                            level = "sentence"
                        out.append([head.strip(), page, sec, "text", box, list(path), level])
                        buf, box = buf[limit - overlap :], None
        flush()
        for b in blocks:
            if b[1] == page and b[5] in chunking.HEADINGS:
                default = (b[4] or "")[:60]
    merged, i = [], 0
    while i < len(out):
        cur, own = out[i], out[i]
        while i + 1 < len(out) and out[i + 1][3] == "text" and o.match(out[i + 1][0].split("\n", 1)[0]):
            cur = [cur[0] + " " + out[i + 1][0], *out[i][1:]]
            i += 1
        merged.append(cur)
        i += 1
    if len(merged) <= 1:
        return merged
    final, wait = [], None
    for c in merged:
        s = c[0].strip()
        if wait is None and len(s) <= 10:
            wait = s
            continue
        if wait:
            c = [wait + "\n" + c[0], *c[1:]]
            wait = None
        final.append(c)
    if wait:
        final.append(merged[-1])
    return final


@pytest.mark.parametrize("seed", range(4))
def test_chunks_against_model(spark, seed):
    r = random.Random(seed)
    kinds = ["text"] * 6 + ["title", "section_heading", "table", "figure", "formula", None]
    words = ["填空题", "1．求值", "（2）证明", "A．一； B．二", "B．二", "short", "x" * 15, "。".join(["句子" * 5] * 4), "8．甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲甲  9．乙乙乙乙乙乙乙乙乙乙乙乙乙乙乙乙乙乙", " ", "Heading of a part", "二、判断", "[IMG_1]；B．图", ""]
    data = []
    for d in range(25):
        n = 0
        for p in range(1, r.randint(2, 4)):
            for _ in range(r.randint(1, 9)):
                data.append((f"d{d:02d}", p, n, f"b{n}", r.choice(words), r.choice(kinds), (float(n), 0.0, 1.0, 1.0) if r.random() < 0.8 else None))
                n += 1
    got: dict[str, list] = {}
    for x in chunking.chunk_documents(spark.createDataFrame(data, BLOCK), 60, 10).orderBy("doc_id", "chunk_seq").collect():
        got.setdefault(x.doc_id, []).append([x.content, x.page_num, x.section, x.chunk_type, x.bbox and tuple(x.bbox), x.layout_tree_path, x.chunk_level])
    for d in sorted({b[0] for b in data}):
        assert got.get(d, []) == model_chunks([b for b in data if b[0] == d], 60, 10), d


def test_pdf_blocks(spark):
    page = ("d", 1, 595.0, 842.0, [(0, [0.0, 0.0, 1.0, 1.0], [([("Hello ", 18.0, "A"), ("world", 11.0, "B")],)]), (1, [0.0, 0.0, 1.0, 1.0], None), (0, [0.0, 0.0, 1.0, 1.0], [([("  ", 1.0, "A")],)])])
    got = src.pdf_blocks(spark.createDataFrame([page], src.TEXT_DICT)).orderBy("block_idx").collect()
    assert [(x.content, x.block_type, x.max_font_size) for x in got] == [("Hello world", "text", 18.0), ("", "image", None)]
    with pytest.raises(Exception):
        spark.createDataFrame([("a.txt",)], "f string").select(src.loader(F.col("f"))).collect()


def _docx(body: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    math = "<w:p><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>α</m:t></m:r></m:den></m:f></m:oMath></w:p>"
    style = '<w:pPr><w:pStyle w:val="Title"/></w:pPr>'
    (tmp_path / "x1_file.docx").write_bytes(_docx(p("Top", style) + p("第一章 开始") + p(" ") + p("plain text that isn't a heading of any kind, as it is far too long for one") + math + table))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = src.read_docx(spark, str(tmp_path)).orderBy("block_idx").collect()
    assert [(x.content, x.block_type) for x in got if x.doc_id == "x1"][:2] == [("Top", "title"), ("第一章 开始", "section_heading")]
    assert [x.content for x in got if x.block_type == "formula"] == ["$$\\frac{1}{\\alpha}$$"]
    assert [x.content for x in got if x.block_type == "table"] == ["a | b"]


def test_formulas():
    from xml.etree import ElementTree as ET

    m = "http://schemas.openxmlformats.org/officeDocument/2006/math"
    run = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    cases = {
        f"<m:sSup><m:e>{run('x')}</m:e><m:sup>{run('2')}</m:sup></m:sSup>": "x^{2}",
        f"<m:rad><m:deg/><m:e>{run('y')}</m:e></m:rad>": "\\sqrt{y}",
        f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{run("i")}</m:sub><m:sup>{run("n")}</m:sup><m:e>{run("k")}</m:e></m:nary>': "\\sum_{i}^{n} k",
        f"<m:d><m:e>{run('a')}</m:e></m:d>": "\\left( a \\right)",
        f"<m:m><m:mr><m:e>{run('1')}</m:e><m:e>{run('2')}</m:e></m:mr></m:m>": "\\begin{matrix} 1 & 2 \\end{matrix}",
    }
    for xml, latex in cases.items():
        assert to_latex(ET.fromstring(f'<m:oMath xmlns:m="{m}">{xml}</m:oMath>')).strip() == latex


def test_stream_equals_batch(spark, data, tmp_path):
    from quirelake.streaming import ingest

    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    q = ingest.index_stream(ingest.file_stream(spark, str(tmp_path / "in"), docs.schema), "doc_id", "text", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("term", "id", "tf", "dl")
    want = index.keyword_index(docs.dropDuplicates(["doc_id"]), "doc_id", "text").postings
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_scorer_chains(spark):
    from quirelake.operators import scorers

    df = spark.createDataFrame([("formula", "a"), ("table", "b"), ("other", "c"), ("table", "d")], "category string, image string")
    only = lambda x, y: lambda c: F.when(c == x, y)
    refuse = lambda c: F.lit("NOT_FORMULA")
    got = scorers.recognised_images(df, scorers.first_of(only("a", "$$x$$"), refuse), only("b", "| t |"), only("d", "text"))
    assert rows(got, "image", "text") == [("a", "$$x$$"), ("b", "| t |"), ("c", scorers.UNREADABLE), ("d", "text")]
    df = spark.createDataFrame([("see [IMG_1] and [IMG_1]", 1, "X"), ("none", 1, "X")], "c string, n int, t string")
    assert [r.v for r in df.select(scorers.placeholder_filled(F.col("c"), F.col("n"), F.col("t")).alias("v")).collect()] == ["see X and [IMG_1]", "none"]
    b = spark.createDataFrame([("d", 1, 4, "text", "text")], "doc_id string, page_num int, block_idx int, content string, block_type string")
    f = spark.createDataFrame([("d", 1, 1, "long enough text"), ("d", 1, 2, "short"), ("d", 1, 3, "another long text")], "doc_id string, page_num int, figure_idx int, text string")
    assert [r.block_idx for r in scorers.described_figures(b, f).orderBy("block_idx").collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        scorers.prompt("nope")


def test_stores(spark, tmp_path):
    from quirelake.sources import stores

    t = spark.createDataFrame([("t1", 1, "f", "queued", None, 0, 0, 3, True, 0.5)], stores.TASK)
    stores.save_tasks(t, str(tmp_path / "t"))
    assert stores.load_tasks(spark, str(tmp_path / "t")).exceptAll(t).count() == 0
    e = spark.createDataFrame([(1, "x")], "seq int, action string")
    stores.append_feedback(e, str(tmp_path / "f"))
    stores.append_feedback(e, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    stores.save_index(spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "term string, id int, tf int"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    left = stores.deleted({"c": spark.createDataFrame([("x",), ("y",), (None,)], "source_file string")}, "x")["c"]
    assert left.count() == 2
    with pytest.raises(ValueError):
        stores.cache_entries(e, "nope", F.col("seq"), F.col("action"))


def test_vector_search_in_tiles(spark):
    """Tiles, sent queries and a plain product give the same rows, ties and other lengths included."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.standard_normal((150, 6)).round(1)
    x[10:30] = x[9]
    rows = [(f"i{k:03d}", [float(c) for c in v]) for k, v in enumerate(x)] + [("short", [1.0, 0.0]), ("zero", [0.0] * 6), ("null", None)]
    u = index.unit_vectors(spark.createDataFrame(rows, "k string, e array<float>"), "k", "e")
    q = u.where("id < 'i050' or id = 'short'").withColumnRenamed("id", "query_id")
    sent = {(a.query_id, a["rank"]): (a.id, a.score) for a in index.vector_search(u, q, 5).collect()}
    tiled = {(a.query_id, a["rank"]): (a.id, a.score) for a in index.vector_search(u, q, 5, sent=0, tile=16).collect()}
    assert sent == tiled and len(sent) == 5 * 50 + 1 and sent["short", 1] == ("short", 1.0)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v) and len(v) == 6}
    unit = {k: (np.float32(dict(rows)[k]).astype(float)) / np.linalg.norm(np.float32(dict(rows)[k]).astype(float)) for k in unit}
    for k in ("i000", "i009", "i049"):
        best = sorted(unit, key=lambda o: (-round(float(unit[k] @ unit[o]), 6), o))[:5]
        assert [sent[k, n][0] for n in range(1, 6)] == best
    assert index.vector_search(u.limit(0), q, 5).count() == 0 == index.vector_search(u, q.limit(0), 5).count()


def test_tokenizer_is_pluggable(spark):
    docs = spark.createDataFrame([(1, "a,b"), (2, "b,b"), (3, "")], "id int, text string")
    made = index.keyword_index(docs, "id", "text", tokenizer=lambda c: F.filter(F.split(c, ","), lambda w: w != ""))
    assert {(r.term, r.df) for r in made.terms.collect()} == {("a", 1), ("b", 2)} and made.stats.first().avgdl == 4 / 3
    got = index.keyword_search(made, spark.createDataFrame([(7, "a,a")], "query_id int, query string")).collect()
    assert [(r.query_id, r.id) for r in got] == [(7, 1)]


def test_hashing_encoder(spark):
    from quirelake.operators import scorers

    got = [r.v for r in spark.createDataFrame([("one two",), ("two one",), ("",), (None,), ("three",)], "t string").select(scorers.hashing_encoder(16)(F.col("t")).alias("v")).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and set(got[2]) == set(got[3]) == {0.0} and len(got[4]) == 16


def test_generator_is_asked_again(spark):
    from quirelake.operators import scorers

    p = spark.createDataFrame([("a", "x"), ("b", " ")], "key string, prompt string")
    none = spark.createDataFrame([], "key string, value string")
    assert {(r.key, r.answer, r.store) for r in scorers.cached_answers(p, none, None).collect()} == {("a", "no answer", False), ("b", "no answer", False)}
    assert {(r.key, r.answer, r.store) for r in scorers.cached_answers(p, none, lambda c: c).collect()} == {("a", "x", True), ("b", "no answer", False)}


def test_collection(spark, tmp_path):
    path = str(tmp_path / "v")
    assert index.open_collection(spark, path, 2).count() == 0
    spark.createDataFrame([("c", "f", [1.0, 2.0])], "chunk_id string, source_file string, embedding array<float>").write.mode("append").parquet(path)
    assert index.open_collection(spark, path, 2).count() == 1
    with pytest.raises(ValueError, match="not 3"):
        index.open_collection(spark, path, 3)


def test_stored_index(spark, tmp_path):
    from quirelake.sources import stores

    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, text string")
    made, path = index.keyword_postings(docs, "id", "text"), str(tmp_path / "p")
    stores.save_index(made, path)
    assert stores.load_index(spark, path).exceptAll(made).count() == 0
    assert {(r.term, r.id) for r in stores.load_index(spark, path, ["b"]).collect()} == {("b", 1), ("b", 2)}
    stores.clear_index(spark, path)
    assert stores.load_index(spark, path).count() == 0
    assert spark.range(1).select(stores.landed_name(F.lit("0a"), F.lit("x.pdf")).alias("n")).first().n == "0a_x.pdf"


def test_failed_searches(spark):
    q = spark.createDataFrame([("q", "word")], "query_id string, query string")
    c = spark.createDataFrame([("c", "a word", None)], "id string, content string, metadata string")
    one = spark.createDataFrame([("q", "c", 1)], "query_id string, id string, rank int")
    from quirelake.operators import retrieval

    assert retrieval.retrieve(None, None, c, q).count() == 0
    assert [(r.id, r["rank"]) for r in retrieval.retrieve(None, one, c, q).collect()] == [("c", 1)]
    got = retrieval.retrieve(one, None, c, q, scorer=lambda q, t: F.lit(None).cast("double")).first()
    assert got["rank"] == 1 and got.score is None


@pytest.mark.parametrize("seed", range(2))
def test_keyword_search_in_place(spark, seed):
    """Over texts in place as over postings: ties beyond k, queries of the same terms, empty texts, repeated terms, a mask; no hit is shuffled."""
    r = random.Random(seed)
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(0, 4))) for _ in range(300)] + [None, "", "图a b"]
    docs = spark.createDataFrame([(f"d{i * 7919 % 1000:03}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a b"), (2, "b A"), (3, "c c d"), (4, "zz"), (5, ""), (6, "h 图a")], "query_id int, query string")
    held, placed = index.keyword_index(docs, "id", "text"), index.keyword_index(docs, "id", "text", unique=True)
    assert rows(placed.terms, "term", "df", "idf") == rows(held.terms, "term", "df", "idf") and placed.stats.collect() == held.stats.collect()
    few = docs.where("id < 'd500'").select("id")
    for allowed in (None, few):
        want = rows(index.keyword_search(held, asked, 7, allowed=allowed), "query_id", "rank", "id", "score")
        got = index.keyword_search(placed, asked, 7, allowed=allowed)
        assert {x[0] for x in want} == {1, 2, 3, 6} and rows(got, "query_id", "rank", "id", "score") == want
        assert rows(index.keyword_search(placed, asked, 7, allowed=allowed, sent=0), "query_id", "rank", "id", "score") == want
    assert "MapInArrow" in index.keyword_search(placed, asked, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert index.keyword_search(placed, asked.limit(0), 7).count() == 0
    assert index.keyword_search(index.keyword_index(docs.limit(0), "id", "text", unique=True), asked).count() == 0


@pytest.mark.parametrize("sent", [None, 0])
def test_distinct_by(spark, sent):
    """Rows of repeated keys are taken together, the others stay as they are, null vectors too; only the first are kept, unless there are too many."""
    from quirelake.catalog import _one_each

    made = [(f"k{i % 95}", "" if i == 3 else f"text {i}", None if i % 7 == 0 else i) for i in range(100)] + [("k90", "text 90", None), ("k50", None, 5)] + [("k60", "text 60", 60)] * 3
    df = spark.createDataFrame(made, "chunk_id string, content string, metadata int").repartition(5)
    got = index.distinct_by(df, "chunk_id", _one_each, sent=sent)
    assert rows(got, "chunk_id", "content", "metadata") == rows(_one_each(df), "chunk_id", "content", "metadata") and got.count() == 95
    pairs = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("a", [2.0]), ("b", None), ("c", [3.0])], "id string, v array<float>")
    assert sorted(map(str, index.distinct_by(pairs, "id", type(pairs).distinct, sent=sent).collect())) == sorted(map(str, pairs.distinct().collect()))
    assert index.distinct_by(df.limit(0), "chunk_id", _one_each, sent=sent).count() == 0
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["context_text", "query_response", "rerank_query", "context_pack", "domain_terms", "rerank_lexical"])
def test_corpus_is_not_kept(spark, data, name):
    """A retrieval query over sf0.01 keeps less on disk than its chunks' contents take, which were kept whole, with all vectors as doubles."""
    from quirelake import catalog

    spark.catalog.clearCache()
    out = catalog.queries()[name](spark, f"{data}/sf0.01")
    assert out.count()
    kept = sum(x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    contents = spark.read.parquet(f"{data}/sf0.01/chunks.parquet").selectExpr("sum(octet_length(content)) n").first().n
    assert 0 < kept < contents


def test_search_shuffles_no_more_with_more_partitions(spark, monkeypatch):
    """What searches shuffle is bounded by cores, queries and k, however many partitions and batches the rows lie in; of many ties the first ids stay."""
    real, seen = index.ranked, []
    monkeypatch.setattr(index, "ranked", lambda scored, *a: seen.append(scored) or real(scored, *a))
    made = [(f"d{i:03}", f"a{i % 3} b{i % 7} a", [float(i % 5), 1.0, float(i % 2)]) for i in range(600)]
    docs = spark.createDataFrame(made, "id string, text string, v array<double>").repartition(40)
    asked = spark.createDataFrame([(q, t, [float(q), 1.0, 0.0]) for q, t in enumerate(["a0", "b3 a", "a1 b1", "nothing"])], "query_id int, query string, v array<double>")
    units = index.unit_vectors(docs, "id", "v")
    asking = index.unit_vectors(asked, "query_id", "v").withColumnRenamed("id", "query_id")
    held, placed = (index.keyword_index(docs, "id", "text", unique=u) for u in (False, True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = index.keyword_search(placed, asked, 6), index.vector_search(units, asking, 6)
        for scored in seen:  # three scores at most may round to one
            assert scored.rdd.getNumPartitions() <= 4 and 0 < scored.count() <= 4 * 4 * 6 * 3
        want = index.keyword_search(held, asked, 6), index.vector_search(units, asking, 6, sent=0, tile=64)
        for a, b in zip(got, want, strict=True):
            assert rows(a, "query_id", "rank", "id", "score") == rows(b, "query_id", "rank", "id", "score")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.catalog.clearCache()


def test_context_pack_keeps_no_contents(spark, data, monkeypatch):
    """What context_pack keeps of its results are numbers and names, no contents."""
    from quirelake import catalog, session
    from quirelake.operators import retrieval

    kept, real = [], session.keep
    for where in (catalog, index, retrieval, session):
        monkeypatch.setattr(where, "keep", lambda df: kept.append(df) or real(df))
    out = catalog.queries()["context_pack"](spark, f"{data}/sf0.01")
    assert [x for x in kept if "query_id" in x.columns] and not [x for x in kept if {"query_id", "content"} <= set(x.columns)]
    assert out.count()
    spark.catalog.clearCache()


def test_many_results_and_repeated_keys(spark, monkeypatch):
    """Beyond the bounds of what is sent, rows without a result or a repeated key still stay where they are; the rows are the same."""
    from quirelake.catalog import _one_each
    from quirelake.operators import retrieval

    contents = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(3000)] + [(None, "none")], "id string, content string").repartition(5)
    results = spark.createDataFrame([(q, f"c{i * 7}", i) for q in range(3) for i in range(q, q + 40)] + [(9, "nowhere", 1)], "query_id int, id string, rank int")
    want = rows(retrieval.with_contents(results, contents), "query_id", "id", "rank", "content")
    assert len(want) == 120
    assert results.select("id").distinct().count() - 1 == 42 <= index.among(contents, "id", results).count() < 100
    again = spark.createDataFrame([(f"k{i % 2900}", f"text {i}", i) for i in range(3000)], "chunk_id string, content string, metadata int").repartition(5)
    once_each = rows(_one_each(again), "chunk_id", "content", "metadata")
    gathered = []
    got = index.distinct_by(again, "chunk_id", lambda df: gathered.append(df) or _one_each(df), sent=99)
    assert rows(got, "chunk_id", "content", "metadata") == once_each and len(once_each) == 2900
    assert 200 <= gathered[0].count() < 300
    for bits in (64, 1 << 16):  # keys that the map can't tell from each other
        monkeypatch.setattr(index, "KEY_BITS", bits)
        monkeypatch.setattr(retrieval, "SENT_RESULTS", 0)
        assert rows(retrieval.with_contents(results, contents), "query_id", "id", "rank", "content") == want
        assert rows(index.distinct_by(again, "chunk_id", _one_each, sent=0), "chunk_id", "content", "metadata") == once_each
    spark.catalog.clearCache()
