"""Problem 9: long spans that stand verbatim in more than one text.

Paragraph MinHash banding, the paragraphs being all stretches of ``least`` characters, one from each
character on:

1. The signature of a paragraph is the smallest hash of its grams under each of ``ROWS`` functions,
   all in one band. Equal paragraphs have equal signatures, so one band loses none of them wherever
   a span begins; more rows and longer grams only part paragraphs that are merely alike. Of the 71
   million paragraphs of the large check table collide with another text's: with grams of 8
   characters and 2, 4, 8, 12 rows 45, 29, 8.2, 5.9 million, with grams of 48 and 2, 3, 4, 5 rows
   9.4, 6.8, 6.2, 6.0 million (5.5 are right). The smallest hash changes only where its gram leaves
   or a smaller one enters, so neighbouring paragraphs share their signature, and a run of them is
   one row: 5.9 million runs with 12 rows of short grams, 2.7 million with 4 of long ones.
2. Colliding runs are joined by their band's key, found by the smallest and largest text per key,
   pre-aggregated, never by listing a bucket.
3. What collides is verified exactly, whole runs first: runs with the same characters from the first
   paragraph's start to the last one's end are verified at once. Only under keys whose runs differ (at
   the ends of shared spans, and where texts are merely alike) the single paragraphs are compared, one
   run standing for all that have its characters.
4. Texts with a verified paragraph in common are linked to the smallest of them, and components of
   these links are the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.components import components
from ..session import keep
from .arrow import map_batches
from .rolling import Windows, code_points, mix, sliding_least

LEAST = 200
GRAM, ROWS = 48, 4
#: Characters hashed at once.
STRETCH = 1 << 17


def _stretches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``STRETCH`` characters together, with the number of the first; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STRETCH:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def signature_runs(texts: list[str], least: int, windows: Windows, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """Which text, band key, first and last start, and hash of the characters of every run of paragraphs of one signature."""
    points = code_points("".join(texts))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(points) - least + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    grams = (windows(points, GRAM) >> np.uint64(32)).astype(np.uint32)
    turns = mix(np.arange(rows, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    lows = [sliding_least(grams * a, least - GRAM + 1) for a in turns]
    begins = np.zeros(n + 1, dtype=bool)
    for low in lows:
        begins[1:n] |= low[1:] != low[:-1]
    begins[starts[starts < n]] = True
    valid = np.zeros(n + 1, dtype=np.int8)  # 1 where a paragraph lies within one text
    long = sizes >= least
    valid[starts[long]] += 1
    np.subtract.at(valid, ends[long] - least + 1, 1)
    inside = np.cumsum(valid[:n], dtype=np.int8) > 0
    begins[n] = True
    at = np.flatnonzero(begins)
    last = at[1:] - 1
    at = at[:-1]
    good = inside[at]
    at = at[good]
    doc = np.searchsorted(ends, at, "right")
    last = np.minimum(last[good], ends[doc] - least)
    key = np.full(len(at), rows, dtype=np.uint64)
    for low in lows:
        key = mix(key ^ low[at])
    whole = windows.spans(points, at, last + least)
    return doc, key.view(np.int64), at - starts[doc], last - starts[doc], whole.view(np.int64)


def _run_rows(texts: DataFrame, kind: str, least: int) -> DataFrame:
    def work(cols: dict, windows: Windows) -> dict:
        parts = [(first + doc, *rest) for first, some in _stretches(cols["text"].to_pylist()) for doc, *rest in (signature_runs(some, least, windows),)]
        doc, key, lo, hi, whole = (np.concatenate(p) for p in zip(*parts, strict=True))
        return {"k": cols["k"].take(pa.array(doc)), "band_key": pa.array(key), "lo": pa.array(lo), "hi": pa.array(hi), "whole": pa.array(whole)}

    return map_batches(texts.where(F.length("text") >= least), work, f"k {kind}, band_key bigint, lo int, hi int, whole bigint", setup=Windows)


def _paragraph_rows(near: DataFrame, kind: str, least: int) -> DataFrame:
    """Hashes of the single paragraphs that start within ``spots``, for the smallest and largest text that have the spot's characters."""

    def work(cols: dict, windows: Windows) -> dict:
        own: dict[str, list[np.ndarray]] = {"at": [], "h": [], "p": [], "spot": []}
        lasts = []
        for i, (t, spots) in enumerate(zip(cols["text"].to_pylist(), cols["spots"].to_pylist(), strict=True)):
            hashes = windows(code_points(t), least)
            for s in spots:
                p = np.arange(s["lo"], min(s["hi"] + 1, len(hashes)))
                own["at"].append(np.full(len(p), i))
                own["spot"].append(np.full(len(p), len(lasts)))
                own["h"].append(hashes[p].view(np.int64))
                own["p"].append(p)
                lasts.append(s["last"])
        at, h, p, spot = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (own["at"], own["h"], own["p"], own["spot"]))
        return {"h": pa.array(h), "k": cols["k"].take(pa.array(at)), "last": pa.array(lasts, cols["k"].type).take(pa.array(spot)), "p": pa.array(p)}

    return map_batches(near, work, f"h bigint, k {kind}, last {kind}, p int", setup=Windows)


def shared_starts(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """``k``, ``lo``, ``hi``, ``first``: the places from ``lo`` to ``hi`` where a span of ``least`` characters starts that another text has too, and the smallest text with it."""
    if least <= GRAM:
        raise ValueError(f"spans must be longer than {GRAM} characters")
    texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    kind = dict(texts.dtypes)["k"]
    runs = _run_rows(texts, kind, least)
    met = keep(runs.groupBy("band_key").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").select("band_key"))
    met.count()  # its size is known to the joins below
    hit = keep(runs.join(met, "band_key"))
    same = keep(hit.groupBy("band_key", "whole").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min_by(F.struct("lo", "hi"), F.struct("k", "lo")).alias("spot")))
    whole = hit.join(same.where("first <> last").select("band_key", "whole", "first"), ["band_key", "whole"]).select("k", "lo", "hi", "first")
    mixed = same.groupBy("band_key").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("band_key")
    open_ = same.join(mixed, "band_key", "left_semi")
    alone = hit.join(open_.where("first = last").select("band_key", "whole"), ["band_key", "whole"], "left_semi")
    spots = alone.select("k", F.struct("lo", "hi", F.col("k").alias("last")).alias("s")).unionByName(open_.where("first <> last").select(F.col("first").alias("k"), F.struct("spot.lo", "spot.hi", "last").alias("s")))
    spots = keep(spots.groupBy("k").agg(F.collect_set("s").alias("spots")))  # bounded by the text's own length
    spots.count()
    single = keep(_paragraph_rows(texts.where(F.length("text") >= least).join(spots, "k").select("k", "text", "spots"), kind, least))
    shared = single.groupBy("h").agg(F.min("k").alias("first"), F.max("last").alias("last")).where("first <> last").select("h", "first")
    return whole.unionByName(single.join(shared, "h").select("k", F.col("p").alias("lo"), F.col("p").alias("hi"), "first"))


def shared_ranges(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """``key``, ``start_char``, ``end_char``: the maximal ranges covered by spans that stand in another text too.

    Rows with a null key or text are left out; a text delivered twice under one key isn't another
    text; a key with two texts has the ranges of both, merged. Shorter and empty texts have none.
    Spans within a text alone don't count. A span that a third of all texts have is handled as any
    other: no list of its texts is made.
    """
    found = shared_starts(df, key, text, least).select("k", "lo", (F.col("hi") + least).alias("end")).distinct()
    line = W.partitionBy("k").orderBy("lo", "end")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("s", F.when(F.col("lo") > F.coalesce(before, F.lit(-1)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("s").over(line.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("k", "run").agg(F.min("lo").alias("start_char"), F.max("end").cast("int").alias("end_char"))
    return out.select(F.col("k").alias(key), "start_char", "end_char")


def shared_share(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """``key``, ``n_chars``, ``shared_chars``, ``shared_share`` of every distinct text; the longest text of a key counts."""
    ranges = shared_ranges(df, key, text, least).groupBy(key).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sizes = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return sizes.join(ranges, key, "left").select(key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_share"))


def shared_clusters(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """``key``, ``cluster``: the texts linked by common windows, and the smallest text of their component."""
    links = shared_starts(df, key, text, least).where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b")).distinct()
    return components(links).select(F.col("node").alias(key), F.col("component").alias("cluster"))
