"""Problem 6: items larger than a limit, cut at natural boundaries with a stated overlap."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches

#: What a cut costs after a blank line, a line break, a sentence, a clause, a word, and elsewhere.
PENALTIES = (0.0, 0.5, 1.0, 3.0, 5.0, 12.0)
_BOUNDARY = regex.compile(
    r"(?P<p0>\n[^\S\n]*\n\s*)|(?P<p1>\n)|(?P<p2>[.!?…。！？．｡।]+[\p{Pe}\p{Pf}\p{Pi}\"']*(?:\s+|(?<=[。！？｡]\p{P}*)))|(?P<p3>[,;:，；：、]\s*)|(?P<p4>\s+)",
)
TORN = 100.0
_MARK = regex.compile(r"[\p{M}‍]")
#: Weight of a piece as such and of its distance from the even size.
PIECE, IMBALANCE = 4.0, 8.0


def _candidates(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end and what that costs; never more than ``step`` apart."""
    at, cost = [0], [0.0]
    for m in _BOUNDARY.finditer(text):
        end = m.end()
        if at[-1] < end < len(text):
            at.append(end)
            cost.append(PENALTIES[int(m.lastgroup[1])])
    at.append(len(text))
    cost.append(0.0)
    if len(at) and max(np.diff(at), default=0) > step:
        more, price = [0], [0.0]
        for p, c in zip(at[1:], cost[1:], strict=True):
            while p - more[-1] > step:
                q = more[-1] + step
                while q > more[-1] + 1 and _MARK.match(text[q]):
                    q -= 1
                torn = bool(_MARK.match(text[q]))  # a letter from its marks: only where nothing else is left
                if torn:
                    q = more[-1] + step
                more.append(q)
                price.append(PENALTIES[-1] + TORN * torn)
            more.append(p)
            price.append(c)
        at, cost = more, price
    return np.array(at, dtype=np.int64), np.array(cost)


def cut_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, in order; a text within the limit is one piece.

    Piece k+1 starts ``overlap`` characters before the end of piece k, so dropping the first
    ``overlap`` characters of every piece but the first and joining gives the text back.
    The ends minimise, over all choices, the penalties of the cuts plus the squared distance of
    the pieces from the even size; no piece is longer than ``max_size``.
    """
    n = len(text)
    if n <= max_size:
        return [(0, n)]
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be smaller than the limit")
    room = max_size - overlap
    at, cost = _candidates(text, max(1, room // 16))
    pieces = -(-(n - overlap) // room)
    even = (n + (pieces - 1) * overlap) / pieces
    best = np.full(len(at), np.inf)
    best[0] = 0.0
    back = np.zeros(len(at), dtype=np.int64)
    starts = np.maximum(at - overlap, 0)
    starts[0] = 0
    first = np.searchsorted(starts, at - max_size, "left")  # the first piece start within reach of each end
    for j in range(1, len(at)):
        i = first[j]
        size = at[j] - starts[i:j]
        total = best[i:j] + IMBALANCE * ((size - even) / even) ** 2
        k = int(total.argmin())
        best[j] = total[k] + PIECE + cost[j]
        back[j] = i + k
    ends, j = [], len(at) - 1
    while j:
        ends.append(j)
        j = int(back[j])
    ends.reverse()
    out, start = [], 0
    for j in ends:
        out.append((start, int(at[j])))
        start = int(starts[j])
    return out


def pieces(df: DataFrame, field: str, key: str, text: str, max_size: int, overlap: int) -> DataFrame:
    """``field``, ``record_id``, ``piece_no`` from 0, ``start_char``, ``end_char``, ``piece`` of every text of ``df`` over the limit.

    Only texts over the limit leave the JVM (``length`` counts code points, as Python does);
    repeated rows count once, null keys and texts are left out, a key with two oversized texts has
    the pieces of both.
    """
    over = df.where(F.col(key).isNotNull() & (F.length(text) > max_size)).select(F.col(key).alias("record_id"), F.col(text).alias("text")).distinct()

    def work(cols: dict) -> dict:
        out: dict[str, list] = {"field": [], "record_id": [], "piece_no": [], "start_char": [], "end_char": [], "piece": []}
        for record, t in zip(cols["record_id"].to_pylist(), cols["text"].to_pylist(), strict=True):
            for no, (a, b) in enumerate(cut_points(t, max_size, overlap)):
                for name, v in zip(out, (field, record, no, a, b, t[a:b]), strict=True):
                    out[name].append(v)
        return out

    kind = dict(over.dtypes)["record_id"]
    return map_batches(over, work, f"field string, record_id {kind}, piece_no int, start_char int, end_char int, piece string")
