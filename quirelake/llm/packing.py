"""Problem 7: texts packed into containers of fixed capacity, near texts together.

Each text's tokens are hashed onto a few random directions; the position on the Hilbert curve
through that space is the sort key. Range partitions of the curve are packed independently, each
with best fit in decreasing size over a sliding stretch of the curve, and hold enough containers
for their last, unfilled one not to matter.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .arrow import map_batches

VOCABULARY = os.environ.get("QUIRELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The public pre-tokenisation pattern of these byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIMENSIONS, BITS = 4, 8
STRETCH, OPEN = 2048, 4096
CONTAINERS_PER_PARTITION = 256


@cache
def tokenizer(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMENSIONS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows); Skilling's transpose form, over all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _place(ids: list[int], directions: np.ndarray) -> np.ndarray:
    """The text's cell: its distinct tokens' directions summed, scaled to a normal, and each coordinate's rank cut into cells."""
    if not ids:
        return np.zeros(DIMENSIONS, dtype=np.int64)
    own = np.unique(np.asarray(ids))
    at = directions[own].sum(0) / math.sqrt(len(own))
    share = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in at])
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def sized(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``item``, ``tokens``, ``curve`` of each distinct row of ``df``; null keys and texts are left out."""

    def work(cols: dict) -> dict:
        enc = tokenizer(vocabulary)
        texts = cols["text"].to_pylist()
        tokens = enc.encode_ordinary_batch(texts, num_threads=1)
        directions = _directions(enc.n_vocab)
        cells = np.array([_place(t, directions) for t in tokens])
        return {"item": cols["item"], "same": cols["same"], "tokens": [len(t) for t in tokens], "curve": hilbert(cells).tolist()}

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    kind = dict(rows.dtypes)["item"]
    return map_batches(rows, work, f"item {kind}, same bigint, tokens int, curve bigint").distinct().drop("same")


class _Packer:
    """Best fit into open containers; ``add`` gives the container of each item of a stretch, largest first."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open = capacity, 0, []  # open: (room, container), sorted

    def add(self, sizes: list[int]) -> list[int]:
        where = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = bisect.bisect_left(self.open, (sizes[i], -1))
            if k < len(self.open):
                room, box = self.open.pop(k)
            else:
                room, box, self.count = self.capacity, self.count, self.count + 1
            where[i] = box
            if room > sizes[i]:
                bisect.insort(self.open, (room - sizes[i], box))
        del self.open[: max(0, len(self.open) - OPEN)]  # the fullest are closed
        return where


def pack(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``container``, ``item``, ``piece``, ``pieces``, ``first_token``, ``tokens``: every distinct row of ``df``, packed.

    A text is split, at token positions, only if it alone exceeds the capacity; its last part is
    packed like any text. Empty texts take no room. A third of the rows with one text don't gather
    in one task: the range partitions are cut by curve position, then key. Containers are numbered
    within their partition, ``partition * 2**32 + number``.
    """
    items = keep(sized(df, key, text, vocabulary))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, int(total // (capacity * CONTAINERS_PER_PARTITION)))
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)
    cut = items.select("item", "curve", F.col("tokens").alias("all"), (last + 1).alias("pieces"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    cut = cut.select("item", "curve", "pieces", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("int").alias("tokens"))
    lined = cut.repartitionByRange(parts, "curve", "item", "piece").sortWithinPartitions("curve", "item", "piece")
    kind = dict(lined.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = _Packer(capacity), TaskContext.get().partitionId() << 32
        names = ["item", "piece", "pieces", "first_token", "tokens"]
        for batch in batches:
            for k in range(0, batch.num_rows, STRETCH):
                part = batch.slice(k, STRETCH)
                where = packer.add(part.column("tokens").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([base + w for w in where], pa.int64()), *(part.column(n) for n in names)], names=["container", *names])

    return lined.select("item", "piece", "pieces", "first_token", "tokens").mapInArrow(run, f"container bigint, item {kind}, piece int, pieces int, first_token int, tokens int")
