"""Problem 3: the k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a
Walsh-Hadamard transform) and assigned to the nearest signed axis: 2d buckets a table. Each vector
is stored in its own bucket of every table and asks the ``probes`` nearest buckets. Buckets are
searched exactly, as matrix products in blocks, and both sides keep what they meet: the one that
asks and the one that is stored. A second, shorter hash splits the buckets when they would exceed
``bucket`` vectors on average; as smaller buckets part far neighbours, more tables are made and more
buckets asked then. A bucket in which more vectors are stored or ask than a tile holds is searched in
tiles, stored against asking ones, so no group holds more than about two tiles and nothing is capped.

Exact copies of a vector are searched once and expanded at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import keep
from .arrow import map_batches

TABLES, PROBES, BUCKET, TILE = 8, 5, 1024, 8192
_BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


class Hash:
    """Cross-polytope hashes of one table: one over all dimensions and, if ``short``, one over ``short`` of them."""

    def __init__(self, dim: int, table: int, short: int):
        self.dim, self.short = 1 << (dim - 1).bit_length(), short
        r = np.random.default_rng([11, table])
        self.signs = r.choice(np.array([-1, 1], dtype=np.float32), (2, 3, self.dim))
        self.some = r.permutation(self.dim)[:short]
        self.buckets = 2 * self.dim * max(1, 2 * short)

    def _turn(self, x: np.ndarray, part: int) -> np.ndarray:
        for s in self.signs[part]:
            x = hadamard(x * s)
        return x

    def __call__(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest buckets of each row, nearest first."""
        if x.shape[1] < self.dim:
            x = np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))
        y = self._turn(x, 0)
        near, cost = _nearest(y, min(probes, self.dim))
        if self.short:
            z = self._turn(x, 1)[:, self.some]
            near2, cost2 = _nearest(z, min(probes, self.short))
            total = (cost[:, :, None] + cost2[:, None, :]).reshape(len(x), -1)
            both = (near[:, :, None] * (2 * self.short) + near2[:, None, :]).reshape(len(x), -1)
            order = np.argsort(total, 1, kind="stable")[:, :probes]
            near = np.take_along_axis(both, order, 1)
        return near


def _nearest(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed axes nearest to each row, and how much farther than the nearest they are; of an axis only its nearer side."""
    size = np.abs(y)
    order = np.argpartition(-size, probes - 1, 1)[:, :probes] if probes < y.shape[1] else np.broadcast_to(np.arange(y.shape[1]), y.shape)
    value = np.take_along_axis(size, order, 1)
    by = np.argsort(-value, 1, kind="stable")
    order, value = np.take_along_axis(order, by, 1), np.take_along_axis(value, by, 1)
    side = np.take_along_axis(y, order, 1) < 0
    return order + side * y.shape[1], (value[:, :1] - value) ** 2


def _units(df: DataFrame, key: str, vector: str, kind: str, dim: int) -> DataFrame:
    def work(cols: dict) -> dict:
        v = cols["v"]
        flat = v.values.slice(v.offsets[0].as_py(), v.offsets[-1].as_py() - v.offsets[0].as_py()).to_numpy(zero_copy_only=False)
        x = flat.reshape(len(v), dim).astype(np.float32)
        with np.errstate(all="ignore"):
            size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            good = np.isfinite(size) & (size > 0)
            x = (x / size[:, None]).astype(np.float32)[good]
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
        return {"id": cols["id"].filter(pa.array(good)), "unit": raw.cast(pa.binary())}

    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda e: e.isNull())).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    return map_batches(rows, work, f"id {kind}, unit binary")


def _matrix(units: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row."""
    return np.argpartition(-s, k - 1, 1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def meet(asks: np.ndarray, ask_ids: np.ndarray, stored: np.ndarray, stored_ids: np.ndarray, k: int, floor: float) -> tuple[list, list, list]:
    """(ids, others, similarities): for each vector of either side the k best of the other one, at least ``floor``, itself left out."""
    ids, others, values = [], [], []
    best_v = np.full((len(stored), k), -np.inf, dtype=np.float32)
    best_i = np.zeros((len(stored), k), dtype=np.int64)
    for at in range(0, len(asks), _BLOCK):
        own = ask_ids[at : at + _BLOCK]
        s = asks[at : at + _BLOCK] @ stored.T
        s[own[:, None] == stored_ids[None, :]] = -np.inf
        rows = np.flatnonzero(s.max(1, initial=-np.inf) >= floor)
        if not len(rows):
            continue
        part = s[rows]
        cols = _best(part, k)
        v = np.take_along_axis(part, cols, 1)
        good = v >= floor
        ids.append(np.repeat(own[rows], good.sum(1)))
        others.append(stored_ids[cols[good]])
        values.append(v[good])
        hit = np.flatnonzero(part.max(0) >= floor)
        down = part[:, hit].T
        cols = _best(down, k)
        merged_v = np.concatenate([best_v[hit], np.take_along_axis(down, cols, 1)], 1)
        merged_i = np.concatenate([best_i[hit], own[rows][cols]], 1)
        top = _best(merged_v, k)
        best_v[hit], best_i[hit] = np.take_along_axis(merged_v, top, 1), np.take_along_axis(merged_i, top, 1)
    good = best_v >= floor
    ids.append(np.repeat(stored_ids, good.sum(1)))
    others.append(best_i[good])
    values.append(best_v[good])
    return ids, others, values


def placed_tiles(classes: DataFrame, hashes: list[Hash], probes: int, dim: int, tile: int) -> DataFrame:
    """``cell``, ``m``, ``q``, ``stored``, ``asks``, ``u``, ``unit``: the vectors ``classes(u, unit)`` in every group (cell, m, q) where they are stored or ask.

    No group has more than about ``tile`` stored and ``tile`` asking rows, however crowded the cell.
    """
    tables = len(hashes)
    cells = hashes[0].buckets

    def load(cols: dict) -> dict:
        x = _matrix(cols["unit"], dim)
        near = [t * cells + h(x, probes) for t, h in enumerate(hashes)]
        home, home_n = np.unique(np.concatenate([c[:, 0] for c in near]), return_counts=True)
        asked, asked_n = np.unique(np.concatenate([c[:, 1:].ravel() for c in near]), return_counts=True)
        none = np.zeros(len(home), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
        return {"cell": np.concatenate([home, asked]).tolist(), "s": np.concatenate([home_n, none[1]]).tolist(), "a": np.concatenate([none[0], asked_n]).tolist()}

    def spread(cols: dict) -> dict:
        x = _matrix(cols["unit"], dim)
        cell = np.concatenate([t * cells + h(x, probes) for t, h in enumerate(hashes)], 1)
        asks = np.tile(np.arange(cell.shape[1]) % (cell.shape[1] // tables) > 0, len(x))  # the nearest bucket is the vector's own
        at = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
        return {"cell": pa.array(cell.ravel()), "stored": pa.array(~asks), "u": cols["u"].take(at), "unit": cols["unit"].take(at)}

    # a bucket with more stored or asking vectors than a tile holds is cut both ways: tiles of stored ones against tiles of asking ones
    loads = map_batches(classes.select("unit"), load, "cell bigint, s bigint, a bigint").groupBy("cell").agg(F.sum("s").alias("s"), F.sum("a").alias("a"))
    hot = loads.where((F.col("s") > tile) | (F.col("a") > tile)).select("cell", F.greatest(F.lit(1), F.ceil(F.col("s") / tile)).alias("ms"), F.ceil((F.col("s") + F.col("a")) / tile).alias("qs"))
    placed = map_batches(classes, spread, "cell bigint, stored boolean, u bigint, unit binary")
    tiled = placed.join(hot, "cell", "left")
    lone = F.col("ms").isNull()  # then the stored vectors ask where they lie; else they are sent to every tile for it
    ms, qs = F.coalesce("ms", F.lit(1)), F.coalesce("qs", F.lit(1))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    stored = tiled.where("stored").select("cell", F.pmod("u", ms).alias("m"), all_of(qs).alias("q"), F.lit(True).alias("stored"), lone.alias("asks"), "u", "unit")
    asking = tiled.where(~F.col("stored") | ~lone).select("cell", all_of(ms).alias("m"), F.pmod("u", qs).alias("q"), F.lit(False).alias("stored"), F.lit(True).alias("asks"), "u", "unit")
    return stored.unionByName(asking)


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = 10, floor: float | None = None, *, dim: int | None = None, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, tile: int = TILE
) -> DataFrame:
    """``id``, ``other``, ``similarity``, ``rank``: the ``k`` most similar other keys of every key, at least ``floor`` similar.

    Null keys, null, all-zero and non-finite vectors, vectors with a null and vectors of another
    length than ``dim`` (left open: the most frequent length) are left out; vectors of any length
    other than 0 are scaled. Repeated rows count once. Equal similarities are ranked by key; where
    more than k copies of one vector exist, each has the k smallest other keys among them.
    The recall depends on ``tables`` and ``probes``; what comes out has its exact similarity.
    Vectors are known by a 64-bit hash on the way.
    """
    kind = dict(df.dtypes)[key]
    lowest = -2.0 if floor is None else floor
    if dim is None:
        first = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = first.n if first and first.n else 1
    owners = keep(_units(df, key, vector, kind, dim).distinct().select("id", F.xxhash64("unit").alias("u"), "unit"))
    classes = owners.groupBy("u").agg(F.first("unit").alias("unit"))
    n = classes.count()
    short, length = 0, 1 << (dim - 1).bit_length()
    while n > bucket * 2 * length * max(1, 2 * short) and short < length:
        short = max(1, 2 * short)
    if floor is None:  # far neighbours are parted by smaller buckets: more tables, and more buckets asked
        level = short.bit_length()
        tables, probes = tables + tables // 2 * (level // 2), probes * (1 + level)
    hashes = [Hash(dim, t, short) for t in range(tables)]
    tiles = placed_tiles(classes, hashes, probes, dim, tile)

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kept, asks = t.column("stored").to_numpy(), t.column("asks").to_numpy()
        x, u = _matrix(t.column("unit"), dim), t.column("u").to_numpy()
        ids, others, values = meet(x[asks], u[asks], x[kept], u[kept], k, lowest) if kept.any() and asks.any() else ([], [], [])
        cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, dtype=kind)
        return pa.table({"u": cat(ids, np.int64), "o": cat(others, np.int64), "s": cat(values, np.float32)})

    met = tiles.groupBy("cell", "m", "q").applyInArrow(search, "u bigint, o bigint, s float")
    # the same pair may be met in several tables: one row each, before the ranking
    pairs = met.groupBy("u", "o").agg(F.max("s").alias("s"))
    ranked = pairs.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "o"))).where(F.col("r") <= k).select("u", "o", "s")
    # each class stands for its k + 1 smallest keys, so every key finds k others even in a class of its own
    line = owners.select("id", "u").withColumn("r", F.row_number().over(W.partitionBy("u").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("id").alias("other"), F.col("u").alias("o"))
    near = ranked.unionByName(line.groupBy("o").count().where("count > 1").select(F.col("o").alias("u"), "o", F.lit(1.0).cast("float").alias("s")))
    full = owners.select("id", "u").join(near, "u").join(line, "o").where("id <> other")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return full.select("id", "other", F.col("s").cast("double").alias("similarity")).withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, key: str, vector: str, floor: float, k: int = 10, **how) -> DataFrame:
    """``id_a`` < ``id_b``: pairs at least ``floor`` similar of which one is among the ``k`` most similar of the other."""
    near = most_similar(df, key, vector, k, floor, **how)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
