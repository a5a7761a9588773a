"""What a task keeps of a ranking: the best of every key, so that only these are shuffled."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``top`` best of each key (0 to ``keys`` - 1) so far, by falling score, then by id (whole numbers)."""

    def __init__(self, keys: int, top: int):
        self.score = np.full((keys, top), -np.inf)
        self.id = np.full((keys, top), np.iinfo(np.int64).max)
        self.floor = self.score[:, -1].copy()  # a key's last place

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Finite scores, one for each key and id."""
        top = self.score.shape[1]
        better = (score > self.floor[key]) | ((score == self.floor[key]) & (ids < self.id[key, -1]))
        if not better.any():
            return
        hit = np.unique(key[better])
        every = np.concatenate([self.score[hit].ravel(), score[better]])
        whose = np.concatenate([self.id[hit].ravel(), ids[better]])
        owner = np.concatenate([np.repeat(hit, top), key[better]])
        order = np.lexsort((whose, -every, owner))
        first = np.searchsorted(owner[order], hit)  # every key has ``top`` places at least
        kept = order[first[:, None] + np.arange(top)]
        self.score[hit], self.id[hit] = every[kept], whose[kept]
        self.floor[hit] = self.score[hit, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, ids and scores of the places taken."""
        key, place = np.nonzero(self.score > -np.inf)
        return key, self.id[key, place], self.score[key, place]
