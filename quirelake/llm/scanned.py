"""Problem 2: noise in text from scanned pages and PDF: page furniture, broken words, misread characters.

Two averaged perceptrons work on it:

* a character editor. At each place where what was read may stand for something else it chooses
  between keep, replace, delete (two read for one), insert (one read for two), and, at the end of
  a line, line-join. Its features are what the edit is, what stands around it, and how often the
  word or, for characters without words around them, the neighbourhood occurs in the whole corpus
  before and after the edit. It is trained on clean text that is misread and broken on purpose.
* a judge of lines at the edges of pages. Its features are the line's place on the page, how many of
  the document's pages have it there, how like the document's other edge lines it is, whether its
  number is the page's, how its shape behaves in the whole corpus. It is trained on the block types that
  PDF parsing gave, which are often wrong, but more often right.

The counts cover all rows; both fits use a bounded sample (``SAMPLE`` blocks, ``EDGES`` lines).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.layout import NUMBERED_HEADING
from ..session import keep
from .arrow import map_batches
from .lookalike import look_alikes, skeleton
from .perceptron import Perceptron, slot

SAMPLE, EDGES, EPOCHS = 2500, 12_000, 3
#: How often a line typed as furniture is shown for one that isn't.
TRUST = 3
SLOTS = 1 << 21  # of the corpus counts
#: What is read, and what may stand there. Usual confusions of recognisers.
MISREAD = {
    "c": "e", "f": "t", "l": "i1t", "1": "li", "0": "oO", "5": "sS", "9": "gq", "b": "h", "6": "bG", "8": "B", "2": "zZ", "O": "0", "I": "l1", "S": "5", "B": "8", "h": "b", "n": "h", "q": "g",
    "rn": "m", "cl": "d", "vv": "w", "ii": "u", "li": "h", "m": ["rn"], "d": ["cl"], "w": ["vv"], "e": "c", "t": "f", "i": "l",
}
#: The same between ideographs and kana.
IDEOGRAPHS = ("由甲申", "力刀", "天夭", "大太犬", "干千", "末未", "水氷", "失矢", "入人", "土士", "日曰", "己已巳", "木本", "王玉", "田由", "鸟乌", "白自", "问间", "治冶", "ソン", "シツ", "ロ口", "ニ二", "カ力", "エ工", "タ夕", "ハ八")
_SAME = {c: "".join(sorted(set("".join(g for g in IDEOGRAPHS if c in g)) - {c})) for c in set("".join(IDEOGRAPHS))}
_TOKEN = re.compile(r"[0-9A-Za-zÀ-ɏ]+")
_HYPHENED = re.compile(r"[A-Za-zÀ-ɏ]+(?:[-‐][A-Za-zÀ-ɏ]+)+")
_HYPHENS = "-‐­"
_BREAK = re.compile(r"([0-9A-Za-zÀ-ɏ]+)([-‐­])[ \t]*\n[ \t]*([0-9A-Za-zÀ-ɏ]+)")
_IDEOGRAPH = re.compile("[" + "".join(sorted(_SAME)) + "]")
_CLEAN = re.compile(r"[^\n一-鿿぀-ヿA-Za-zÀ-ɏ0-9]")


def _slot(kind: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + what) & (SLOTS - 1)


def _around(text: str, i: int) -> tuple[str, str, str]:
    """The three neighbourhoods of position ``i``, the place itself marked."""
    a, b, c, d = text[max(0, i - 2) : max(0, i - 1)], text[max(0, i - 1) : i], text[i + 1 : i + 2], text[i + 2 : i + 3]
    return f"{b}_{c}", f"{a}{b}_", f"_{c}{d}"


class _Counts:
    """What the editor's features need to know about texts. Tokens and neighbourhoods are counted as they stand and taken apart once each."""

    def __init__(self) -> None:
        self.tokens, self.compounds, self.places = Counter(), Counter(), Counter()

    def add(self, text: str) -> None:
        self.tokens.update(_TOKEN.findall(text))
        self.compounds.update(_HYPHENED.findall(text))
        flat = "\0\0" + text.replace("\n", "") + "\0\0"
        self.places.update([flat[m.start() - 2 : m.start() + 3] for m in _IDEOGRAPH.finditer(flat)])

    def __len__(self) -> int:
        return len(self.tokens) + len(self.compounds) + len(self.places)

    def slots(self) -> Counter:
        own: Counter = Counter()
        for w, n in self.tokens.items():
            if not w.isdigit():
                w = w.lower()
                own["w" + w] += n
                for part in triples(w):
                    own["3" + part] += n
        for w, n in self.compounds.items():
            own["h" + w.lower().replace("‐", "-")] += n
        for p, n in self.places.items():
            a, b, here, c, d = (x.strip("\0") for x in p)
            for k, where in enumerate((f"{b}_{c}", f"{a}{b}_", f"_{c}{d}")):
                own[f"i{k}{here}{where}"] += n
        return own


def triples(word: str) -> list[str]:
    """The letter triples of a word with its ends marked."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def corpus_counts(df: DataFrame, text: str) -> np.ndarray:
    """The counts over all rows; their number of slots is fixed, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Counts()

        def out() -> pa.RecordBatch:
            made = own.slots()
            slots = np.fromiter((xxhash.xxh3_64_intdigest(k) & (SLOTS - 1) for k in made), np.int64, len(made))
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(made.values(), pa.int64())], names=["slot", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own.add(t)
            if len(own) > 400_000:
                yield out()
                own = _Counts()
        if len(own):
            yield out()

    found = df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    counts = np.zeros(SLOTS, dtype=np.int32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return counts


def _level(n: int, most: int = 8) -> int:
    return 0 if n <= 0 else min(most, int(n).bit_length())


class Editor:
    """Finds what was misread and where words were broken; ``fit`` trains it."""

    def __init__(self, counts: np.ndarray, model: Perceptron | None = None, bar: float = 0.0):
        self.counts, self.model, self.known, self.bar = counts, model or Perceptron(), {}, bar

    def count(self, kind: str, what: str) -> int:
        return int(self.counts[_slot(kind, what)])

    def edits(self, token: str) -> list[tuple[int, str, str]]:
        """(position, read, meant) of every edit of the token that a confusion allows."""
        out = []
        for i in range(len(token)):
            for size in (1, 2):
                read = token[i : i + size]
                if len(read) == size:
                    out += [(i, read, meant) for meant in MISREAD.get(read, ())]
        return out

    def token_features(self, token: str, i: int, read: str, meant: str, more: int = 0, less: int = 0) -> list[int]:
        new = token[:i] + meant + token[i + len(read) :]
        old_n, new_n = _level(self.count("w", token.lower()) + more), _level(self.count("w", new.lower()) - less)
        kind = "replace" if len(read) == len(meant) else "delete" if len(read) > len(meant) else "insert"
        rest = token[:i] + token[i + len(read) :]
        left, right = token[i - 1 : i], token[i + len(read) : i + len(read) + 1]
        side = lambda c: "." if not c else "9" if c.isdigit() else "A" if c.isupper() else "a"
        around = "9" if rest.isdigit() else "a" if rest.isalpha() and not rest.isupper() else "A" if rest.isalpha() else "." if not rest else "x"
        swap = ("9" if read.isdigit() else "a") + ("9" if meant.isdigit() else "a")
        size = min(4, len(token))
        # the rarest letter triple that the edit touches, before and after
        low, then = token.lower(), new.lower()
        old_3 = min(_level(self.count("3", part), 14) for part in triples(low)[max(0, i - 1) : i + len(read) + 1])
        new_3 = min(_level(self.count("3", part), 14) for part in triples(then)[max(0, i - 1) : i + len(meant) + 1])
        seen = f"{min(2, old_n)}{min(2, new_n)}"
        out = [f"k{kind}", f"e{read}>{meant}", f"s{kind}{swap}{around}", f"c{swap}{side(left)}{side(right)}{around}", f"n{swap}{old_n},{new_n}", f"o{swap}{around}{old_n}", f"w{swap}{around}{new_n}", f"l{swap}{size},{min(2, new_n)}", f"g{swap}{max(-3, min(5, new_n - old_n))}{around}", f"3{swap}{seen}{max(-6, min(6, new_3 - old_3))}", f"r{swap}{seen}{old_3 // 2}", f"q{read}>{meant}{seen}{max(-3, min(3, (new_3 - old_3) // 2))}"]
        return [slot("t" + f) for f in out]

    def place_features(self, flat: str, i: int, meant: str) -> list[int]:
        where = _around(flat, i)
        levels = [(_level(self.count("i", f"{n}{flat[i]}{p}")), _level(self.count("i", f"{n}{meant}{p}"))) for n, p in enumerate(where)]
        out = [f"{n}:{min(4, a)},{min(6, b)}" for n, (a, b) in enumerate(levels)] + [f"e{flat[i]}>{meant}", "any"] + [f"d{max(-4, min(4, sum(b - a for a, b in levels) // 3))}"]
        return [slot("i" + f) for f in out]

    def join_features(self, left: str, hyphen: str, right: str, less: int = 0) -> list[int]:
        a, b = left.lower(), right.lower()
        joined, own = _level(self.count("w", a + b) - less), _level(self.count("h", f"{a}-{b}"))
        alone = _level(self.count("w", a)), _level(self.count("w", b))
        shape = "9" if right[0].isdigit() else "A" if right[0].isupper() else "a"
        code = "c" if left.isupper() or left[-1].isdigit() else "w"
        soft = "s" if hyphen == "­" else "h"
        out = [f"{soft}{shape}{code}", f"j{min(3, joined)}{soft}", f"o{min(3, own)}{soft}", f"jo{min(3, joined)},{min(3, own)}", f"a{min(4, alone[0])},{min(4, alone[1])},{min(2, joined)},{min(2, own)}", "any"]
        return [slot("j" + f) for f in out]

    def token(self, token: str, bar: float = 0.0) -> tuple[int, str, str] | None:
        """The edit chosen for a token, if any scores above ``bar``."""
        key = token, bar
        if key in self.known:
            return self.known[key]
        got = None
        code = sum(c.isupper() for c in token) > 1 and any(c.isdigit() for c in token)  # of a part or an order
        if not token.isdigit() and not code and len(token) > 1:
            edits = self.edits(token)
            if edits:
                k = self.model.choose([self.token_features(token, *e) for e in edits], bar)
                got = edits[k - 1] if k else None
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[key] = got
        return got

    def place(self, flat: str, i: int, bar: float = 0.0) -> str | None:
        """What was meant by the ideograph at ``i``, if not what was read."""
        key = flat[max(0, i - 2) : i + 3], min(i, 2), bar
        if key not in self.known:
            options = _SAME[flat[i]]
            k = self.model.choose([self.place_features(flat, i, m) for m in options], bar)
            self.known[key] = options[k - 1] if k else None
        return self.known[key]

    def joins(self, left: str, hyphen: str, right: str) -> bool:
        return bool(self.model.choose([self.join_features(left, hyphen, right)]))

    def work(self, text: str, recognised: bool = True) -> tuple[list[tuple[int, str, str]], list[tuple[int, int, str]]]:
        """Edits (position, read, meant) of ``text``, and breaks (start, end, what replaces it) at which a word goes on.

        What no recogniser has read is held to be right unless an edit scores above all that clean words get in training.
        """
        bar = 0.0 if recognised else self.bar
        edits, breaks = [], []
        whole: dict[int, tuple[str, int, int]] = {}  # start of a broken word: the word, where its second part starts, how much lies between
        skip: set[int] = set()
        if "\n" in text:
            for m in _BREAK.finditer(text):
                if self.joins(m[1], m[2], m[3]):
                    breaks.append((m.start(2), m.start(3), ""))
                    whole[m.start(1)] = m[1] + m[3], m.start(3), len(m[1])
                    skip.add(m.start(3))
        for m in _TOKEN.finditer(text):
            at = m.start()
            if at in skip:
                continue
            word, second, first = whole.get(at, (m[0], 0, len(m[0])))
            got = self.token(word, bar)
            if got:
                i, read, meant = got
                edits.append((at + i if i < first else second + i - first, read, meant))
        spots = list(_IDEOGRAPH.finditer(text))
        if spots:
            flat, at = text, None
            if "\n" in text:
                at = [i for i, c in enumerate(text) if c != "\n"]
                flat = text.replace("\n", "")
                spots = list(_IDEOGRAPH.finditer(flat))
            for m in spots:
                meant = self.place(flat, m.start(), bar)
                if meant:
                    edits.append((m.start() if at is None else at[m.start()], m[0], meant))
        return edits, breaks

    def fit(self, texts: list[str], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 5) -> Editor:
        """Trains on clean texts, misread and broken on purpose."""
        r = random.Random(seed)
        back: dict[str, list[str]] = {}
        for read, meants in MISREAD.items():
            for meant in meants:
                back.setdefault(meant, []).append(read)
        steps = []
        for text in texts:
            words = _TOKEN.findall(text)
            for w in words:
                if w.isdigit() and len(w) < 2 or len(w) > 40:
                    continue
                options = [(i, meant, read) for i in range(len(w)) for size in (1, 2) for meant in (w[i : i + size],) if len(meant) == size for read in back.get(meant, ())]
                pick = r.choice(options) if options and r.random() < rate else None
                # letters for letters in a word that the corpus has nowhere else can't be told from another word
                if pick and (self.count("w", w.lower()) > 1 or (pick[1] + pick[2]).isalnum() and not (pick[1] + pick[2]).isalpha()):
                    i, meant, read = pick
                    token = w[:i] + read + w[i + len(meant) :]
                    gold = (i, read, meant)
                elif w.isdigit():
                    continue
                else:
                    token, gold = w, None
                edits = self.edits(token) if len(token) > 1 else []
                if edits and (gold is None or gold in edits):
                    steps.append(("t", token, 1 + edits.index(gold) if gold else 0))
                if len(w) > 4 and w.isalpha() and r.random() < 0.1:
                    k = r.randint(2, len(w) - 2)
                    steps.append(("j", w[:k], r.choice(_HYPHENS), w[k:], 1))
            for w in _HYPHENED.findall(text):
                parts = re.split("[-‐]", w)
                steps.append(("j", parts[-2], "-", parts[-1], 0))
            for m in re.finditer(r"\b([A-Z]{1,3})[-‐](\d+)", text):
                steps.append(("j", m[1], "-", m[2], 0))
            flat = text.replace("\n", "")
            for m in _IDEOGRAPH.finditer(flat):
                i, c = m.start(), m[0]
                if r.random() < 0.3:
                    meant, c = c, r.choice(_SAME[c])
                    here = flat[:i] + c + flat[i + 1 :]
                    steps.append(("i", here[max(0, i - 3) : i + 4], min(i, 3), 1 + _SAME[c].index(meant)))
                else:
                    steps.append(("i", flat[max(0, i - 3) : i + 4], min(i, 3), 0))
        # in a misread text the word itself would stand once less in the corpus, and what was read once more
        made: dict[tuple, np.ndarray] = {}
        for n, step in enumerate(steps):
            if step not in made:
                kind, *what, gold = step
                if kind == "t":
                    rows = [self.token_features(what[0], *e, int(gold > 0), int(k == gold)) for k, e in enumerate(self.edits(what[0]), 1)]
                elif kind == "j":
                    rows = [self.join_features(*what, gold)]
                else:
                    rows = [self.place_features(*what, m) for m in _SAME[what[0][what[1]]]]
                made[step] = np.array(rows, dtype=np.int32)
            steps[n] = made[step], step[-1]
        del made
        for _ in range(epochs):
            r.shuffle(steps)
            for candidates, gold in steps:
                self.model.learn(candidates, gold)
        self.model = self.model.averaged()
        clean = [self.model.best(candidates)[1] for candidates, gold in steps if not gold]
        self.bar = max([0.0, *clean])
        self.known.clear()
        return self


# lines at the edges of pages

_DIGITS = str.maketrans("lIO", "110")
_NUMBER = regex.compile(r"\p{Nd}+")
_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
TOP, BOTTOM = 2, 3


def edge_lines(df: DataFrame) -> DataFrame:
    """The first and last lines of each page: their place, key (letters only), shape (a hash, numbers as #) and first number.

    ``df`` has doc_id, page_num, block_idx, block_id, content, block_type, one row per block. Blank
    lines have no place.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(look_alikes(spark))  # bounded by Unicode's size

    def work(cols: dict, table: dict) -> dict:
        counts, found = [], []
        for t in cols["content"].to_pylist():
            lines = [(i, s.strip()) for i, s in enumerate((t or "").split("\n"), 1) if s.strip()]
            n, own = len(lines), []
            for k, (no, s) in enumerate(lines):
                if k < TOP or k >= n - BOTTOM:
                    form = skeleton(s, table).lower()
                    number = _NUMBER.search(form)
                    own.append({"line_no": no, "k": k, "key": _LETTERS.sub("", form), "shape": xxhash.xxh3_64_intdigest(_NUMBER.sub("#", form).encode("utf-8", "surrogatepass")) - 2**63, "number": int(number[0]) if number and len(number[0]) < 7 else None})
            counts.append(n)
            found.append(own)
        return {n: cols[n] for n in ("doc_id", "page_num", "block_idx", "block_id", "block_type", "single")} | {"n": counts, "lines": found}

    rows = map_batches(
        df.select("doc_id", "page_num", "block_idx", "block_id", "block_type", "content", "single"),
        work,
        "doc_id string, page_num int, block_idx int, block_id string, block_type string, single boolean, n int, lines array<struct<line_no: int, k: int, key: string, shape: bigint, number: int>>",
        setup=lambda: shared.value,
    )
    page = W.partitionBy("doc_id", "page_num")
    line = page.orderBy("block_idx", "block_id")
    before = F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("before", before).withColumn("all", F.sum("n").over(page))
    out = placed.select("doc_id", "page_num", "block_id", "block_type", "single", "before", "all", F.explode("lines").alias("l"))
    out = out.select("doc_id", "page_num", "block_id", "block_type", "single", "l.line_no", "l.key", "l.shape", "l.number", (F.col("before") + F.col("l.k")).cast("int").alias("top"), (F.col("all") - F.col("before") - F.col("l.k") - 1).cast("int").alias("bottom"))
    return out


def _with_corpus(lines: DataFrame) -> DataFrame:
    """What the document and the corpus tell about each edge line; ``lines`` has all short lines, edge or not."""
    edge = (F.col("top") < TOP) | (F.col("bottom") < BOTTOM)
    side = F.when(F.col("top") < TOP, "t").when(F.col("bottom") < BOTTOM, "b").otherwise("m")
    lines = lines.withColumn("side", side)
    hit = (F.col("number") == F.col("page_num")).cast("int")
    shapes = lines.where("number is not null").groupBy("shape").agg(F.avg(hit).alias("shape_hits"), F.count("*").alias("shape_n"), F.avg((F.col("bottom") < 2).cast("int")).alias("shape_low"))
    keys = lines.where("key <> ''").groupBy("key").agg(F.approx_count_distinct("doc_id").alias("key_docs"), F.avg((F.col("bottom") < 2).cast("int")).alias("key_low"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_num").alias("pages"))
    spread = lines.where("key <> '' and side <> 'm'").groupBy("doc_id", "side", "key").agg(F.countDistinct("page_num").alias("key_pages"))
    # the document's running line, if it has one, and the two lines that open its first page: what other lines may be a variant of
    most = spread.where("side = 't'").groupBy("doc_id").agg(F.max_by("key", F.struct("key_pages", "key")).alias("running"))
    first = lines.where("page_num = 1 and top < 2").groupBy("doc_id").agg(F.min_by("key", "top").alias("opening"), F.max_by("key", "top").alias("second"))
    line = W.partitionBy("doc_id", "page_num").orderBy("top")
    out = lines.where(edge).withColumn("next", F.lead("key").over(line)).withColumn("prev", F.lag("key").over(line))
    out = out.join(shapes, "shape", "left").join(keys, "key", "left").join(spread, ["doc_id", "side", "key"], "left")
    return out.join(pages, "doc_id", "left").join(most, "doc_id", "left").join(first, "doc_id", "left")


def _alike(a: str | None, b: str | None) -> int:
    """0 different, 1 one cut short or a few letters apart, 2 equal."""
    if not a or not b:
        return 0
    if a == b:
        return 2
    if min(len(a), len(b)) >= 6 and (a.startswith(b) or b.startswith(a)):
        return 1
    if abs(len(a) - len(b)) > 4 or min(len(a), len(b)) < 5:
        return 0
    pairs = Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))
    return int(sum(pairs.values()) >= 0.7 * (max(len(a), len(b)) - 1))


def line_features(r: dict) -> list[int]:
    share = (r["key_pages"] or 0) / max(1, r["pages"] or 1)
    repeated = 0 if (r["key_pages"] or 0) < 2 else 1 + min(3, int(share * 5))
    n = len(r["key"] or "")
    size = 0 if n == 0 else 1 if n <= 3 else 2 if n <= 12 else 3
    number = "-" if r["number"] is None else "=" if r["number"] == r["page_num"] else "x"
    hits = "-" if r["shape_hits"] is None else str(int(r["shape_hits"] * 4.99)) + str(min(2, int(r["shape_n"] or 0) // 3))
    docs = (int(r["key_docs"] or 0) > 1) + (int(r["key_docs"] or 0) > 2) + (int(r["key_docs"] or 0) > 5)
    low = 0 if r["key_low"] is None else int(r["key_low"] * 3.99)
    low_shape = "-" if r["shape_low"] is None else int(r["shape_low"] * 2.99)
    like = max(_alike(r["key"], r["running"]), _alike(r["key"], r["opening"]), _alike(r["key"], r["second"]))
    top, bottom = min(r["top"], 2), min(r["bottom"], 3)
    first = r["page_num"] == 1
    after, before = _alike(r["key"], r["next"]), _alike(r["key"], r["prev"])
    title = f"{int(first)}{min(1, after)}{min(1, before)}{like}"
    out = [
        f"place{top}{bottom}", f"rep{repeated}{top}", f"repb{repeated}{bottom}", f"title{title}{top}", f"num{number}{size}{bottom}", f"numt{number}{size}{top}", f"hits{hits}{number}{size}", f"hits{hits}{bottom}{top}",
        f"docs{docs}{low}{bottom}", f"shape{hits}{low_shape}{size}", f"like{like}{top}{int(first)}{number}", f"size{size}{top}{bottom}", "any",
    ]
    return [slot("f" + f) for f in out]


_COLUMNS = ("page_num", "key", "shape_hits", "shape_n", "shape_low", "key_docs", "key_low", "key_pages", "pages", "running", "opening", "second", "next", "prev", "top", "bottom", "number")
FURNITURE = ("header", "footer", "page_number")


def furniture_lines(df: DataFrame) -> DataFrame:
    """``block_id``, ``line_no`` of the running headers, footers and page numbers."""
    rows = keep(_with_corpus(keep(edge_lines(df))))
    # the parser's types as labels: lines of blocks of one line, in a fixed arbitrary order
    labelled = rows.where("single and block_type is not null").select(F.col("block_type").isin(*FURNITURE).alias("gold"), *_COLUMNS).orderBy(F.xxhash64("block_id", "line_no")).limit(EDGES).toArrow().to_pylist()
    # page numbers may stand at the top as well: they are shown there too
    labelled += [{**r, "top": 0, "bottom": 5, "next": None, "prev": None} for r in labelled if r["gold"] and len(r["key"] or "") <= 8 and r["bottom"] == 0]
    model = Perceptron()
    # much furniture is typed as text, hardly any text as furniture: what is typed as furniture counts more
    steps = [(np.array([line_features(r)], dtype=np.int32), int(r["gold"])) for r in labelled for _ in range(TRUST if r["gold"] else 1)]
    r = random.Random(3)
    for _ in range(EPOCHS + 1):
        r.shuffle(steps)
        for s in steps:
            model.learn(*s)
    shared = df.sparkSession.sparkContext.broadcast(model.averaged().w)  # of fixed size

    def judge(cols: dict, weights: np.ndarray) -> dict:
        own = Perceptron(weights)
        names = list(_COLUMNS)
        columns = [cols[n].to_pylist() for n in names]
        good = [own.choose([line_features(dict(zip(names, v, strict=True)))]) > 0 for v in zip(*columns, strict=True)]
        return {"block_id": cols["block_id"], "line_no": cols["line_no"], "good": good}

    judged = map_batches(rows.select("block_id", "line_no", *_COLUMNS), judge, "block_id string, line_no int, good boolean", setup=lambda: shared.value)
    return judged.where("good").select("block_id", "line_no").distinct()


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """The rows with a block_id and content, each once."""
    rows = blocks.where("block_id is not null and content is not null")
    return rows.select("doc_id", "page_num", "block_idx", "block_id", "block_type", "content", "metadata").dropDuplicates(["block_id", "content"])


def paged_blocks(blocks: DataFrame) -> DataFrame:
    """The distinct blocks of documents that have pages (PDF and scans): those without any block that carries a paragraph style or comes from a text box."""
    styled = blocks.where("metadata.style is not null or metadata.source = 'textbox'").select("doc_id").distinct()
    rows = blocks.select("doc_id", "page_num", "block_idx", "block_id", "block_type", "content", F.coalesce(F.col("metadata.source"), F.lit("")).alias("source"))
    return rows.join(styled, "doc_id", "left_anti").withColumn("single", F.instr("content", "\n") == 0)


def fitted_editor(blocks: DataFrame, sample: int = SAMPLE) -> Editor:
    """The editor, with counts over all of ``blocks`` and trained on a sample of the unscanned ones."""
    counts = corpus_counts(blocks, "content")
    clean = blocks.where("content is not null and metadata is not null and metadata.source is null").select("block_id", "content").orderBy(F.xxhash64("block_id"), "block_id").limit(sample).collect()  # bounded by the parameter
    return Editor(counts).fit([r.content for r in clean])


def _shared_editor(blocks: DataFrame):
    e = fitted_editor(blocks)
    return blocks.sparkSession.sparkContext.broadcast((e.counts, e.model.w, e.bar))  # both of fixed size


def noise(blocks: DataFrame) -> DataFrame:
    """``block_id``, ``line_no``, ``noise`` (furniture, hyphen, misread): one row per line and kind.

    ``blocks`` has the columns of the table of that name; rows with a null block_id or content are
    left out, repeated rows count once. A line that is furniture has no other noise.
    """
    blocks = keep(distinct_blocks(blocks))
    paged = keep(paged_blocks(blocks))
    shared = _shared_editor(blocks)

    def work(cols: dict, editor: Editor) -> dict:
        out: dict[str, list] = {"block_id": [], "line_no": [], "noise": []}
        for block, t, source in zip(*(cols[n].to_pylist() for n in ("block_id", "content", "source")), strict=True):
            edits, breaks = editor.work(t, source != "")
            found = {(t.count("\n", 0, at) + 1, "misread") for at, _, _ in edits} | {(t.count("\n", 0, a) + 1, "hyphen") for a, _, _ in breaks}
            for no, kind in found:
                out["block_id"].append(block)
                out["line_no"].append(no)
                out["noise"].append(kind)
        return out

    lines = furniture_lines(paged)
    others = map_batches(paged.select("block_id", "content", "source"), work, "block_id string, line_no int, noise string", setup=lambda: Editor(shared.value[0], Perceptron(shared.value[1]), shared.value[2]))
    return others.join(lines, ["block_id", "line_no"], "left_anti").distinct().unionByName(lines.withColumn("noise", F.lit("furniture")))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``page_num``, ``block_idx``, ``block_id``, ``paragraph_no``, ``text``: the pages as continuous paragraphs.

    Furniture is gone, misread characters are put right, broken words are whole, lines of a
    paragraph are joined (by a space, or by nothing between scripts without spaces); a blank line
    or the end of a block ends a paragraph. Lines with a table's bars or a heading stay lines.
    """
    blocks = keep(distinct_blocks(blocks))
    paged = keep(paged_blocks(blocks))
    shared = _shared_editor(blocks)
    gone = furniture_lines(paged).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))

    def work(cols: dict, editor: Editor) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "page_num", "block_idx", "block_id", "paragraph_no", "text")}
        for i, (t, lines, source) in enumerate(zip(*(cols[n].to_pylist() for n in ("content", "gone", "source")), strict=True)):
            for no, p in enumerate(repaired(t, set(lines or ()), editor, source != "")):
                for n in ("doc_id", "page_num", "block_idx", "block_id"):
                    out[n].append(cols[n][i].as_py())
                out["paragraph_no"].append(no)
                out["text"].append(p)
        return out

    return map_batches(paged.join(gone, "block_id", "left").select("doc_id", "page_num", "block_idx", "block_id", "content", "gone", "source"), work, "doc_id string, page_num int, block_idx int, block_id string, paragraph_no int, text string", setup=lambda: Editor(shared.value[0], Perceptron(shared.value[1]), shared.value[2]))


_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}。、，；：！？）」』”]$")


_HEAD = re.compile(NUMBERED_HEADING)
_CLOSED = regex.compile(r"[.!?:。！？：…][\p{Pe}\p{Pf}\"”’]*$")


def _heading(line: str, before: str) -> bool:
    """Whether a line that begins a paragraph, or follows a closed one, is a numbered heading."""
    return len(line) <= 60 and bool(_HEAD.search(line)) and not _CLOSED.search(line) and line[-1] not in ",;，；、" and (not before or bool(_CLOSED.search(before)))


def repaired(text: str, gone: set[int], editor: Editor | None, recognised: bool = True) -> list[str]:
    """The paragraphs of a block without the lines ``gone`` and, with an editor, without misread characters and broken words."""
    body = "\n".join(line for no, line in enumerate(text.split("\n"), 1) if no not in gone)
    if editor is not None:
        edits, breaks = editor.work(body, recognised)
        for at, end, to in sorted([(a, a + len(r), m) for a, r, m in edits] + breaks, reverse=True):
            body = body[:at] + to + body[end:]
    out, now = [], ""
    for line in body.split("\n"):
        line = line.strip()
        alone = line.startswith("|") or bool(line) and _heading(line, now)
        if not line or alone or now.startswith("|"):
            if now:
                out.append(now)
            now = "" if alone else line
            if alone:
                out.append(line)
        elif now:
            now += ("" if _SPACELESS.search(now) else " ") + line
        else:
            now = line
    return out + [now] if now else out
