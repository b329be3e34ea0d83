"""Numbers for words, with a row of properties each, so that texts can be handled as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from annolake.llm.common import words


class WordTable(dict):
    """word -> row of `rows`. Forgets all at the next batch once it holds `limit` words.

    properties: gives the rows of a list of words. forget: called when all is forgotten.
    """

    def __init__(self, properties: Callable[[list[str]], np.ndarray], width: int, limit: int = 200_000, forget: Callable[[], None] = lambda: None):
        super().__init__()
        self.properties, self.width, self.limit, self.forget = properties, width, limit, forget
        self.rows, self.fresh = np.zeros((0, width)), []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, and the number of words of each text."""
        if len(self) >= self.limit:
            self.clear()
            self.forget()
            self.rows = np.zeros((0, self.width))
        ids, counts = [], []
        for text in texts:
            own = words(text)
            counts.append(len(own))
            ids.append(np.fromiter(map(self.__getitem__, own), np.int64, len(own)))
        if self.fresh:
            self.rows = np.concatenate([self.rows, np.asarray(self.properties(self.fresh), float).reshape(-1, self.width)])
            self.fresh = []
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(counts, np.int64)


def by_text(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """ufunc.reduce over each text's values; `empty` for texts without any."""
    out = np.full((len(counts), *values.shape[1:]), empty, values.dtype)
    full = counts > 0
    if full.any():
        out[full] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out
