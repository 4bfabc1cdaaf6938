"""An averaged perceptron over hashed binary features, for choosing one of several candidates."""

from __future__ import annotations

import zlib

import numpy as np

SLOTS = 1 << 17


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SLOTS - 1)


class Perceptron:
    """Chooses between keeping (0) and the candidates (1, 2, ...), each a row of feature slots; keeping scores 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros(SLOTS) if weights is None else weights
        self._sum, self._seen = np.zeros(SLOTS), 0

    def best(self, candidates: np.ndarray | list[list[int]]) -> tuple[int, float]:
        """The best candidate and its score."""
        scores = self.w[np.asarray(candidates)].sum(1)
        k = int(scores.argmax())
        return k + 1, float(scores[k])

    def choose(self, candidates: np.ndarray | list[list[int]], bar: float = 0.0) -> int:
        """The best candidate, if it scores above ``bar``."""
        if not len(candidates):
            return 0
        k, score = self.best(candidates)
        return k if score > bar else 0

    def learn(self, candidates: np.ndarray | list[list[int]], gold: int) -> None:
        """One step: the gold candidate's features gain, the chosen one's lose; the average is kept lazily."""
        self._seen += 1
        got = self.choose(candidates)
        if got != gold:
            for at, by in ((gold, 1.0), (got, -1.0)):
                if at:
                    np.add.at(self.w, candidates[at - 1], by)
                    np.add.at(self._sum, candidates[at - 1], by * self._seen)

    def averaged(self) -> Perceptron:
        return Perceptron(self.w - self._sum / (self._seen + 1))
