"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import cutting, leaks, near_copies, packing, perceptron, rolling, scanned, sentences, shared_spans, similar
from quirelake.llm import lookalike as look


def pairs(df, a="id_a", b="id_b"):
    return {(r[a], r[b]) for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark):
    return look.look_alikes(spark)


# 1


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ａｂ１", "Ab1", True), ("é", "é", True), ("a​b﻿", "ab", True), ("a b", "a b", True), ("Ре", "Pe", True), ("ﬁn", "fin", True), ("⼤", "大", True), ("Ω", "Ω", True), ("a‐b", "a-b", True), ("ΡΙ", "PI", True),
        ("m²", "m2", False), ("①", "1", False), ("rn", "m", False), ("0", "O", False), ("l", "I", False), ("a–b", "a-b", False), ("a\nb", "a b", False), ("é", "e", False),
    ],
)
def test_skeleton(table, a, b, same):
    assert (look.skeleton(a, table) == look.skeleton(b, table)) is same


def test_skeleton_is_idempotent(table):
    r = random.Random(1)
    pool = [chr(r.randint(32, 0x2FFF)) for _ in range(3000)] + list("ａｂ１ﬁ⼤Ωéà…“”")
    for _ in range(300):
        s = look.skeleton("".join(r.choices(pool, k=12)), table)
        assert look.skeleton(s, table) == s
    assert look.skeleton("", table) == ""


def test_look_alike_pairs(spark):
    rows = [("t", "a", "Pe"), ("t", "b", "Ре"), ("t", "c", "Pe"), ("t", "c", "Pe"), ("u", "d", "Pe"), ("t", "e", None), (None, "f", "Ре"), ("t", None, "Ре"), ("t", "g", ""), ("t", "h", "​"), ("t", "i", "x" * 50000), ("t", "j", "х" * 50000)]
    df = spark.createDataFrame(rows, "tbl string, id string, content string").withColumn("look", F.lit(1)).withColumn("written", F.lit("clash"))
    assert pairs(look.look_alike_pairs(df, "tbl", "id")) == {("a", "b"), ("b", "c"), ("g", "h"), ("i", "j")}
    assert look.look_alike_pairs(df.limit(0), "tbl", "id").count() == 0


# 2


def test_perceptron_learns():
    r, p = random.Random(0), perceptron.Perceptron()
    for _ in range(300):
        x = r.randint(0, 9)
        p.learn([[perceptron.slot(f"x{x}")]], int(x > 4))
    p = p.averaged()
    assert [p.choose([[perceptron.slot(f"x{x}")]]) for x in range(10)] == [int(x > 4) for x in range(10)]


@pytest.fixture(scope="module")
def editor(spark, data):
    b = spark.read.parquet(f"{data}/sf0.01/blocks.parquet")
    return scanned.fitted_editor(b, 600), [r.content for r in b.where("metadata.style = 'Normal' and content is not null").orderBy(F.desc("block_id")).limit(150).collect()]


def test_editor_on_held_out_text(editor):
    """Precision and recall on text of its own kind, misread on purpose."""
    e, texts = editor
    r, hits, wrong, missed = random.Random(2), 0, 0, 0
    for text in texts:
        spots = [m for m in scanned._TOKEN.finditer(text) if m[0].isalpha() and len(m[0]) > 5 and m[0].isascii() and e.count("w", m[0].lower()) > 20]
        for m in r.sample(spots, min(2, len(spots))):
            k = next((i for i, c in enumerate(m[0]) if c in "eot"), None)
            if k is None:
                continue
            bad = text[: m.start() + k] + {"e": "c", "o": "0", "t": "f"}[m[0][k]] + text[m.start() + k + 1 :]
            edits, _ = e.work(bad)
            at = {p for p, _, _ in edits}
            hits += m.start() + k in at
            missed += m.start() + k not in at
            wrong += len(at - {m.start() + k})
    assert hits > 20 and hits / (hits + missed) > 0.85 and hits / (hits + wrong) > 0.85


def test_editor_breaks(editor):
    e, _ = editor
    text = "the quality en-\ngineer saw the two-\nstage gearbox"
    _, breaks = e.work(text)
    assert [text[a:b] for a, b, _ in breaks] == ["-\n"] and breaks[0][0] < 20
    assert e.work("") == ([], [])
    assert scanned.repaired("Header\nthe quality en-\ngineer\nsaw leakage\n\nnext", {1}, e) == ["the quality engineer saw leakage", "next"]


def test_noise_edges(spark, data):
    b = spark.read.parquet(f"{data}/sf0.001/blocks.parquet")
    got = scanned.noise(b)
    assert got.columns == ["block_id", "line_no", "noise"]
    both = got.groupBy("block_id", "line_no").agg(F.collect_set("noise").alias("n")).collect()
    assert all(len(x.n) == 1 for x in both if "furniture" in x.n)
    assert scanned.noise(b.limit(0)).count() == 0
    assert scanned.noise(b.withColumn("content", F.lit(None).cast("string"))).count() == 0
    assert {tuple(x) for x in scanned.noise(b.union(b)).collect()} == {tuple(x) for x in got.collect()}


# 3


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(similar.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    assert np.allclose(similar.hadamard(similar.hadamard(x)), x, atol=1e-5)


def _vectors(spark, x, extra=()):
    return spark.createDataFrame([(f"v{i:04d}", [float(c) for c in r]) for i, r in enumerate(x)] + list(extra), "id string, v array<float>")


@pytest.mark.parametrize("tile", [8192, 40])
def test_similar_against_brute_force(spark, tile):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 64))
    x = np.concatenate([c + 0.35 * r.standard_normal((12, 64)) for c in centres] + [r.standard_normal((1, 64)) + 0.02 * r.standard_normal((120, 64))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:10]}
    got = {(a.id, a.other) for a in similar.most_similar(_vectors(spark, x), "id", "v", tile=tile).collect()}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("short", [1, 2, 4, 8])
def test_recall_where_buckets_are_split(spark, data, short):
    df = spark.read.parquet(f"{data}/sf0.01/vectors.parquet").select("chunk_id", "embedding")
    rows = {r.chunk_id: np.array(r.embedding) for r in df.collect() if r.embedding and len(r.embedding) == 64 and any(r.embedding)}
    ids, x = sorted(rows), np.stack([rows[k] for k in sorted(rows)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T).round(6)
    np.fill_diagonal(s, -2)
    tenth = -np.sort(-s, 1)[:, 9]
    got = Counter(r.id for r in similar.most_similar(df, "chunk_id", "embedding", bucket=len(np.unique(u.round(7), axis=0)) / (192 * short)).collect() if r.similarity >= tenth[ids.index(r.id)] - 1e-5)
    assert sum(got.values()) / (10 * len(ids)) >= 0.9


def test_no_tile_is_crowded(spark):
    """A dense group: its vectors share their bucket, and nearly all ask the same second one."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal((1, 64)) + 0.05 * r.standard_normal((3000, 64)), r.standard_normal((300, 64))])
    units = similar._units(_vectors(spark, x), "id", "v", "string", 64).select(F.xxhash64("unit").alias("u"), "unit")
    sizes = similar.placed_tiles(units, [similar.Hash(64, t, 0) for t in range(2)], 4, 64, 200).groupBy("cell", "m", "q").agg(F.count_if("stored").alias("s"), F.count_if("asks").alias("a")).agg(F.max("s"), F.max("a")).first()
    assert max(sizes) < 300


def test_similar_edges(spark):
    one = [1.0] + [0.0] * 7
    extra = [("z", [0.0] * 8), ("n", None), ("short", [1.0]), (None, one), ("e", []), ("nan", [float("nan")] + [0.0] * 7)] + [(f"c{i:02d}", one) for i in range(15)] + [("c00", one)] + [("near", [2.0, 0.2] + [0.0] * 6)]
    df = spark.createDataFrame(extra, "id string, v array<float>").withColumn("u", F.lit(1)).withColumn("unit", F.lit(2))
    got = similar.most_similar(df, "id", "v", 10, dim=8).collect()
    by = Counter(r.id for r in got)
    assert set(by) == {f"c{i:02d}" for i in range(15)} | {"near"} and all(n == 10 for n in by.values())
    assert [r.other for r in sorted(got, key=lambda r: r["rank"]) if r.id == "c00"] == [f"c{i:02d}" for i in range(1, 11)]
    assert similar.most_similar(df.limit(0), "id", "v").count() == 0
    assert ("c00", "near") in pairs(similar.similar_pairs(df, "id", "v", 0.9, dim=8)) or ("c01", "near") in pairs(similar.similar_pairs(df, "id", "v", 0.9, dim=8))


# 4


def _brute(texts, t, shingle, least):
    """Counts of word n-grams, their common part over the larger counts."""
    bags = {}
    for k, s in texts:
        words = s.lower().split()
        if len(words) >= least:
            bags[k] = Counter(zip(*(words[i:] for i in range(shingle)), strict=False))
    ks = sorted(bags)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if (bags[a] & bags[b]).total() >= t * (bags[a] | bags[b]).total()}


@pytest.mark.parametrize(("how", "seed"), [({}, 0), ({"tile": 6}, 1), ({"heavy_above": 60}, 2), ({"heavy_above": 0}, 3), ({"heavy_above": 40, "tile": 6}, 4), ({"sketches": 0}, 5)])
def test_near_copies_against_brute_force(spark, how, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for g in range(25):
        base = r.choices(vocab, k=r.randint(30, 110))
        for m in range(r.randint(1, 4)):
            own = list(base)
            for _ in range(r.randint(0, 9)):
                own[r.randrange(len(own))] = r.choice(vocab)
            if r.random() < 0.3:
                k = r.randrange(len(own))
                own = own[k:] + own[:k]
            texts.append((f"k{g:02d}{m}", " ".join(own)))
    texts += [("copy", texts[0][1].upper()), ("short", "w1 w2"), ("empty", "")]
    df = spark.createDataFrame([*texts, ("null", None), (None, texts[0][1]), texts[3]], "id string, content string").withColumn("n", F.lit("clash"))
    got = pairs(near_copies.near_copy_pairs(df, "id", "content", 0.6, 3, 20, **how))
    assert got == _brute(texts, 0.6, 3, 20)


def test_near_copies_keep_no_keys(spark):
    """The join keeps the elements of all rows, of the distinct sets and of those that met on disk, but no keys."""
    import random

    from quirelake.session import on_its_own

    r = random.Random(5)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(400)) for _ in range(60)]
    texts += [t + " more words" for t in texts[:30]] + texts[:3] + [texts[4]]
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)] + [("000", texts[0])] * 3 + [("005", texts[5])], "id string, content string")
    store = lambda: {x.id(): x.diskSize() + x.memSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    before = store()
    got = on_its_own(lambda spark, _: near_copies.near_copy_pairs(df, "id", "content", 0.6, 3, 20))(spark, "")
    found = got.collect()
    assert len(found) == 30 + 3 + 3 + 1 + 1  # edited, edited copies, copies, and the copy of an edited text's origin twice
    assert sum(n for k, n in store().items() if k not in before) < 3 * 8 * 400 * (len(texts) + 4)


def test_near_copy_groups(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    df = spark.createDataFrame([("1", a), ("2", a + " z"), ("3", a), ("4", b)], "id string, content string")
    got = {r.id: r for r in near_copies.near_copy_groups(df, "id", "content").collect()}
    assert got["1"].near_group == got["2"].near_group == got["3"].near_group != got["4"].near_group
    assert got["1"].copy_class == got["3"].copy_class and got["2"].links == 1 and got["4"].links == 0
    assert near_copies.near_copy_groups(df.limit(0), "id", "content").count() == 0


def test_same_file(spark):
    names = ["0123456789ab_Records_of_Bael_0000091.docx", "aa23456789ab_records of bael 0000091 (2).pdf", "bb23456789ab_Recrods_of_Bael_0000091-copy.pdf", "cc23456789ab_Records_of_Bael_0000092.pdf", "dd23456789ab_Quite_another_title_0000091.pdf", "no number.pdf", None]
    df = spark.createDataFrame([(n,) for n in names + names[:1]], "source_file string")
    assert pairs(near_copies.same_file_pairs(df, "source_file")) == {(names[0], names[1]), (names[0], names[2]), (names[1], names[2])}
    assert near_copies.same_file_pairs(df.limit(0), "source_file").count() == 0


@pytest.mark.parametrize("crowded", [10**6, 0])
def test_crowded_serial(spark, crowded):
    r, titles = random.Random(3), set()
    for _ in range(40):
        t = "".join(r.choices("ghijkm", k=r.randint(1, 26)))
        for _ in range(3):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(u))
                kind = r.randrange(4)
                if kind == 0:
                    u[k : k + 2] = u[k : k + 2][::-1]
                elif kind == 1:
                    u[k] = r.choice("ghijkm")
                elif kind == 2 and len(u) > 1:
                    del u[k]
                else:
                    u.insert(k, r.choice("ghijkm"))
            titles.add("".join(u))
    names = [f"{t}_1234567.pdf" for t in sorted(titles)]
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = a.split("_")[0], b.split("_")[0]
            most = near_copies._forgiven(max(len(x), len(y)), 0.15)
            if near_copies.slips(x, y, most) <= most:
                want.add((min(a, b), max(a, b)))
    got = pairs(near_copies.same_file_pairs(spark.createDataFrame([(n,) for n in names], "f string"), "f", crowded=crowded))
    assert len(want) > 30 and got == want


# 5


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. A. Smith saw 3.5 mm.", " It stopped!", " Why?"], ["“Stop it!” shouted the clerk of Ulm.", " Then he left."], ["“Who came?” asked Mr. X, “and was it seen?”", " See Fig. 5 and p. 7."], ["7. « Arrêtez ! » a crié M. Dupont.", " Voir fig. 2."],
        ["Am 2. März wurde es z. B. geprüft, siehe S. 12.", " Danach nicht."], ["«¡Paren!», gritó el Sr. Paz.", " ¿Fue así?", " ¡Con fuga!"], ["班组说：“已经好了。只有3.5 mm。”但记录不符。", "是否完成？"], ["「止めろ！」と彼が叫んだ。", "次は？"], ["डॉ. राम ने कहा।", " क्या हुआ?"], ["“रोको!” दल ने कहा।"],
        ["No mark at all"], ["one\n", "two.\n", "three"], ["It grew… and fell."], ["War es so.", "Bei Licht nicht."], ["วาล์วหลักรุ่น XG-3337 ได้รับการตรวจสอบแล้วหรือไม่", " หากเสียงผิดปกติเกิน 83 kPa ให้หยุดทันที"],
    ],
)
def test_sentences(table, parts):
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at - (len(p) - len(p.rstrip())))
    assert sentences.sentence_ends("".join(parts), table) == ends


def test_sentence_units(spark):
    df = spark.createDataFrame([("t", "a", "One.  Two."), ("t", "a", "One.  Two."), ("t", "b", ""), ("t", "c", None), ("t", None, "x"), ("t", "d", "A. " * 20000), ("t", "e", " \n ")], "tbl string, id string, content string").withColumn("u", F.lit(1))
    got = sentences.sentence_units(df, "tbl", "id")
    assert sorted((r.record_id, r.start_char, r.end_char) for r in got.where("record_id <> 'd'").collect()) == [("a", 0, 4), ("a", 6, 10)]
    assert sentences.sentence_units(df.limit(0), "tbl", "id").count() == 0


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("He said no. Then he left.", ["He said no.", "Then he left."]),
        ("We looked at the art. The guide spoke.", ["We looked at the art.", "The guide spoke."]),
        ("Plan B failed. We chose plan C. Nothing worked.", ["Plan B failed.", "We chose plan C.", "Nothing worked."]),
        ("राम गया. वह घर आया.", ["राम गया.", "वह घर आया."]),
        ("Mr. T. Fidra came to the hall. See Fig. 3, No. 4 and Sec. IV of it.", ["Mr. T. Fidra came to the hall.", "See Fig. 3, No. 4 and Sec. IV of it."]),
        ("Das ist die Nr. HL-3516 und die Abb. 3, z. B. hier. Gut.", ["Das ist die Nr. HL-3516 und die Abb. 3, z. B. hier.", "Gut."]),
        ("Selon M. Durand, p. ex. 3 m de fuite. Fin.", ["Selon M. Durand, p. ex. 3 m de fuite.", "Fin."]),
    ],
)
def test_abbreviations_by_language(text, units):
    ends = sentences.sentence_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)] == units


# 6


@pytest.mark.parametrize("seed", range(4))
def test_cuts(seed):
    r = random.Random(seed)
    for _ in range(60):
        text = "".join(r.choices("abc def. ghi, 中文。\n\ń", k=r.randint(0, 900)))
        size = r.randint(8, 120)
        lap = r.randint(0, size // 2)
        got = cutting.cut_points(text, size, lap)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= size for a, b in got)
        whole = text[got[0][0] : got[0][1]]
        for (_, e0), (s1, e1) in zip(got, got[1:], strict=False):
            assert s1 == max(0, e0 - lap) and e1 > e0
            whole += text[e0:e1]
        assert whole == text


def test_cuts_at_boundaries():
    text = ("word " * 9 + "end. ") * 20
    assert all(text[:e].endswith(". ") for _, e in cutting.cut_points(text, 240, 0))
    with pytest.raises(ValueError):
        cutting.cut_points("x" * 20, 10, 10)


def test_pieces(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("a", "x" * 30), ("b", "short"), ("c", None), (None, "y" * 99), ("d", "")], "id string, content string")
    got = cutting.pieces(df, "f", "id", "content", 20, 5).orderBy("piece_no").collect()
    assert {r.record_id for r in got} == {"a"} and "".join(r.piece[5:] if r.piece_no else r.piece for r in got) == "x" * 30


# 7


def test_hilbert_is_a_curve():
    n = np.array([[x, y, z, w] for x in range(4) for y in range(4) for z in range(4) for w in range(4)])
    key = packing.hilbert(n, 2)
    assert sorted(key) == list(range(256))
    line = n[np.argsort(key)]
    assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


def test_pack(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choices("alpha beta gamma delta".split(), k=r.randint(1, 60)))) for i in range(400)] + [(900, "alpha beta " * 300), (901, ""), (902, None), (None, "x"), (5, None)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string").withColumn("item", F.lit("clash"))
    got = packing.pack(df, "doc_id", "text", 100).collect()
    full = Counter()
    for x in got:
        full[x.container] += x.tokens
    enc = packing.tokenizer()
    want = {i: len(enc.encode_ordinary(t)) for i, t in rows if t is not None and i is not None}
    have = Counter()
    for x in got:
        have[x.item] += x.tokens
    assert max(full.values()) <= 100 and {k: v for k, v in want.items() if v} == {k: v for k, v in have.items() if v} and 901 in {x.item for x in got}
    assert {x.item for x in got if x.pieces > 1} == {900} and sum(full.values()) / (100 * len(full)) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "text", 100).count() == 0


# 8


@pytest.mark.parametrize("limit", [10**9, 0])
def test_leaks(spark, limit):
    r = random.Random(5)
    w = lambda k: " ".join(f"t{r.randint(0, 400)}" for _ in range(k))
    items = [(i, w(r.randint(5, 40))) for i in range(30)]
    docs = []
    for d in range(120):
        text = w(30)
        if d % 3 == 0:
            words = r.choice(items)[1].split()
            k = r.randint(8, 20)
            a = r.randint(0, max(0, len(words) - k))
            text += ", " + "  ".join(words[a : a + k]).upper() + ". " + w(10)
        docs.append((d, text))
    want = set()
    for d, t in docs:
        x = leaks.words(t)
        runs = {tuple(x[i : i + 12]) for i in range(len(x) - 11)}
        want |= {(d, i) for i, s in items if any(tuple(leaks.words(s)[k : k + 12]) in runs for k in range(len(leaks.words(s)) - 11))}
    df = spark.createDataFrame([*docs, (500, None), (None, items[0][1]), (501, ""), docs[0]], "doc_id int, text string").withColumn("item", F.lit(1))
    it = spark.createDataFrame([*items, (99, None), (98, "")], "item_id int, text string").withColumn("k", F.lit(1))
    got = leaks.leaks(df, "doc_id", "text", it, "item_id", "text", index_chars=limit)
    assert want and pairs(got, "doc_id", "item_id") == want
    assert leaks.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text", index_chars=limit).count() == 0


# 9


def _brute_ranges(docs, least):
    seen: dict[str, set] = {}
    for k, t in docs:
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], set()).add(k)
    out = set()
    for k, t in docs:
        run = None
        for p in range(len(t) - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                if run and p <= run[1]:
                    run = (run[0], p + least)
                else:
                    out |= {(k, *run)} if run else set()
                    run = (p, p + least)
        out |= {(k, *run)} if run else set()
    return out


@pytest.mark.parametrize("seed", range(2))
def test_shared_ranges(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdefgh ij中", k=n))
    stock = [text(r.choice([199, 200, 201, 230, 400, 900])) for _ in range(12)]
    docs = []
    for d in range(60):
        docs.append((d, "".join(r.choice([text(r.randint(1, 300)), r.choice(stock)]) for _ in range(r.randint(0, 4)))))
    docs += [(100, "a" * 900), (101, "b" + "a" * 500), (102, stock[0] * 2)]
    df = spark.createDataFrame([*docs, (103, None), (None, stock[0]), docs[1], (104, "")], "doc_id int, text string").withColumn("k", F.lit(1)).withColumn("p", F.lit(1))
    got = {(x.doc_id, x.start_char, x.end_char) for x in shared_spans.shared_ranges(df, "doc_id", "text").collect()}
    assert got == _brute_ranges(docs, 200)


def test_signature_runs():
    """The runs cover every paragraph of each text once, and equal paragraphs have equal keys."""
    r = random.Random(4)
    stock = "".join(r.choices("abcdef", k=260))
    texts = ["".join(r.choices("abcdef", k=n)) + stock[: r.choice([0, 220, 260])] for n in (0, 3, 199, 200, 700)] + [stock, "x" * 210]
    doc, key, lo, hi, whole = shared_spans.signature_runs(texts, 200, rolling.Windows())
    keys = {(d, p): k for d, k, a, b in zip(doc, key, lo, hi, strict=True) for p in range(a, b + 1)}
    assert sorted(keys) == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 199)]
    by: dict[str, set] = {}
    for (d, p), k in keys.items():
        by.setdefault(texts[d][p : p + 200], set()).add(k)
    assert all(len(v) == 1 for v in by.values()) and len(set(map(tuple, by.values()))) > len(by) // 60


def test_shared_share_and_clusters(spark):
    r = random.Random(9)
    s = "".join(r.choices("abcdefg", k=300))
    df = spark.createDataFrame([(1, s + "x"), (2, "y" + s), (3, "zz"), (4, "")], "doc_id int, text string")
    got = {x.doc_id: (x.shared_chars, x.shared_share) for x in shared_spans.shared_share(df, "doc_id", "text").collect()}
    assert got == {1: (300, round(300 / 301, 6)), 2: (300, round(300 / 301, 6)), 3: (0, 0.0), 4: (0, 0.0)}
    assert {(x.doc_id, x.cluster) for x in shared_spans.shared_clusters(df, "doc_id", "text").collect()} == {(1, 1), (2, 1)}
    assert shared_spans.shared_ranges(df.limit(0), "doc_id", "text").count() == 0


def test_letters_and_marks_stay_together():
    assert all(unicodedata.category(t[e : e + 1] or "a")[0] != "M" for t in ["á" * 40] for _, e in cutting.cut_points(t, 15, 0)[:-1])


def test_near_copies_keep_the_driver_small(spark):
    """The meeting's plan ends where its pairs are written, so later plans don't repeat it; bitmaps and counters come to the driver packed, and whole."""
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(words[i % 40 : i % 40 + 60])) for i in range(80)], "id int, content string").repartition(3)
    pairs = near_copies.near_copy_pairs(df, "id", "content", 0.6, 3, 20)
    assert "meet(" not in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count()
    sets = near_copies.element_sets(df, "id", "content", 3, 20).dropDuplicates(["s"]).select("s", "n", "e")
    names, order, bits = near_copies._bitmaps(sets, 8, 32)
    held = {r.s: np.array(r.e, dtype=np.int64) for r in sets.collect()}
    assert list(names) == sorted(held)
    for s, at in zip(names, order, strict=True):
        assert (bits[at] == np.concatenate([near_copies.bitmap(held[s], w) for w in (8, 32)])).all()
    counted = [(5, 1), (7, 2), (near_copies.COUNTERS - 1, 70_000), (0, 3)]
    got = near_copies._frequencies(spark.createDataFrame(counted, "c int, count bigint").repartition(2))
    assert {int(c): int(got[c]) for c in np.flatnonzero(got > 1)} == {7: 2, near_copies.COUNTERS - 1: 65535, 0: 3} and got.min() == 1
    empty = near_copies._bitmaps(sets.limit(0), 8)
    assert [len(x) for x in empty] == [0, 0, 0]
    spark.catalog.clearCache()
