"""Best entries of many searches at once, as flat arrays inside a task."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


class TopLists:
    """The k entries with the highest scores of each of `rows` lists, equal scores by ascending id."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NONE, np.int64)
        self.ids = np.full((rows, k), _LAST, np.int64)

    def least(self) -> np.ndarray:
        """The kth score of each list; NONE while it has fewer entries."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer entries (row, score, id); an entry that ties with the kth is decided by its id."""
        if not len(rows):
            return
        touched = np.unique(rows)
        row = np.concatenate((np.repeat(touched, self.k), rows))
        score = np.concatenate((self.scores[touched].reshape(-1), scores))
        name = np.concatenate((self.ids[touched].reshape(-1), ids))
        order = np.lexsort((name, ~score, row))  # ~score: descending, without overflow
        first = np.searchsorted(row[order], touched)
        kept = order[first[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = score[kept], name[kept]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all entries."""
        row, place = np.nonzero(self.scores != NONE)
        return row, self.scores[row, place], self.ids[row, place]
