"""Problem 8: passages of evaluation items inside training texts.

A leak is a run of at least ``least`` consecutive words that a text and an item have in common.
Both sides are winnowed: of every ``window`` consecutive k-grams of words, the one of smallest
hash is kept. With k + window - 1 = least, every run that counts keeps at least one k-gram on both
sides, so joining the fingerprints misses none; each hit is then extended word by word, so nothing
shorter comes out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .rolling import Windows, winnow

GRAM = 5
#: Characters of item text up to which the items' index is sent to every executor; beyond it, the fingerprints are joined.
INDEX_CHARS = 16_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, without case."""
    return _WORD.findall(text.lower())


class _Prints:
    """Winnowed k-gram fingerprints of texts; word hashes are remembered up to a bound."""

    def __init__(self, least: int):
        if least <= GRAM:
            raise ValueError(f"the shortest leak must be longer than {GRAM} words")
        self.window, self.known, self.windows = least - GRAM + 1, {}, Windows()

    def hashes(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out[i] = h
        return out

    def __call__(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, fingerprints)."""
        grams = self.windows(self.hashes(ws), GRAM)
        at = winnow(grams, self.window)
        return at, grams[at]


def _run(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int]:
    """The run of equal words around ``a[i]`` and ``b[j]``, as positions in ``a``."""
    lo = 0
    while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi, most = 0, min(len(a) - i, len(b) - j)
    while hi < most and a[i + hi] == b[j + hi]:
        hi += 1
    return i - lo, i + hi


def _index(items: list[tuple], prints: _Prints) -> tuple[dict[int, list[tuple[int, int]]], list[list[str]], list]:
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    texts, ids = [], []
    for n, (item, text) in enumerate(items):
        ws = words(text)
        texts.append(ws)
        ids.append(item)
        for p, h in zip(*prints(ws), strict=True):
            index[int(h)].append((n, int(p)))
    return index, texts, ids


def _longest(ws: list[str], prints: _Prints, made: tuple, least: int) -> dict[int, tuple[int, int]]:
    """Item number to the longest run in common with it, as word positions of ``ws``."""
    index, texts, _ = made
    best: dict[int, tuple[int, int]] = {}
    seen: dict[tuple[int, int], int] = {}  # item and shift to where its last run ends
    if len(ws) < least:
        return best
    for p, h in zip(*prints(ws), strict=True):
        for n, q in index.get(int(h), ()):
            if p < seen.get((n, p - q), 0):
                continue
            a, b = _run(ws, int(p), texts[n], q)
            seen[n, p - q] = b
            if b - a >= least and (n not in best or b - a > best[n][1] - best[n][0]):
                best[n] = (a, b)
    return best


@cache
def _made(items: tuple, least: int) -> tuple:
    prints = _Prints(least)
    return prints, _index(list(items), prints)


def leaks(texts: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``key``, ``item``, ``n_words``: each text and item with a run of at least ``least`` words in common, and the longest run's length.

    Rows with a null key or text are left out, repeated rows count once, empty texts match nothing.
    If the items' text is within ``index_chars`` (it is measured), their index goes to every
    executor and the texts are read once, without a shuffle; otherwise fingerprints of both sides
    are joined and only the hit pairs are read again to be extended.
    """
    items = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).distinct()
    texts = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    kind, item_kind = dict(texts.dtypes)["k"], dict(items.dtypes)["item"]
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if size <= index_chars:
        shared = items.sparkSession.sparkContext.broadcast(tuple(sorted((r.item, r.item_text) for r in items.collect())))  # its size was just checked

        def work(cols: dict, made: tuple) -> dict:
            prints, index = made
            out: dict[str, list] = {"k": [], "item": [], "n_words": []}
            for k, t in zip(cols["k"].to_pylist(), cols["text"].to_pylist(), strict=True):
                for n, (a, b) in _longest(words(t), prints, index, least).items():
                    out["k"].append(k)
                    out["item"].append(index[2][n])
                    out["n_words"].append(b - a)
            return out

        found = map_batches(texts, work, f"k {kind}, item {item_kind}, n_words int", setup=lambda: _made(shared.value, least))
    else:
        found = _joined(texts, items, kind, item_kind, least)
    return found.groupBy("k", "item").agg(F.max("n_words").alias("n_words")).select(F.col("k").alias(key), F.col("item").alias(item), "n_words")


def _joined(texts: DataFrame, items: DataFrame, kind: str, item_kind: str, least: int) -> DataFrame:
    def prints_of(df: DataFrame, name: str, text: str, kind: str) -> DataFrame:
        def work(cols: dict, prints: _Prints) -> dict:
            out: dict[str, list] = {name: [], "print": []}
            for k, t in zip(cols[name].to_pylist(), cols[text].to_pylist(), strict=True):
                ws = words(t)
                if len(ws) >= least:
                    own = set(prints(ws)[1].astype(np.int64).tolist())
                    out[name] += [k] * len(own)
                    out["print"] += own
            return out

        return map_batches(df, work, f"{name} {kind}, print bigint", setup=lambda: _Prints(least))

    pairs = prints_of(texts, "k", "text", kind).join(prints_of(items, "item", "item_text", item_kind), "print").select("k", "item").distinct()
    both = pairs.join(texts, "k").join(items, "item")

    def verify(cols: dict, prints: _Prints) -> dict:
        out: dict[str, list] = {"k": [], "item": [], "n_words": []}
        for k, i, t, u in zip(*(cols[n].to_pylist() for n in ("k", "item", "text", "item_text")), strict=True):
            for a, b in _longest(words(t), prints, _index([(i, u)], prints), least).values():
                out["k"].append(k)
                out["item"].append(i)
                out["n_words"].append(b - a)
        return out

    return map_batches(both, verify, f"k {kind}, item {item_kind}, n_words int", setup=lambda: _Prints(least))
