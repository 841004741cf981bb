"""The k best of each query among what a task has seen: what is shuffled is k rows for each query and task."""

from __future__ import annotations

import numpy as np

#: Entries that are kept before those beyond the k best are dropped.
HELD = 1 << 20


class Best:
    """The k entries of least score of each of n queries; ties go to the smaller doc."""

    def __init__(self, n: int, k: int):
        self.k, self.limits = k, np.full(n, np.inf)
        self.queries, self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: a row for each query, a column for each doc; infinite ones are no entries."""
        limits = self.limits
        if len(docs) >= self.k and np.isinf(limits).any():
            limits = np.minimum(limits, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1])
        q, d = np.nonzero((scores <= limits[:, None]) & (scores < np.inf))
        self.more.append((q, scores[q, d], docs[d]))
        self.waiting += len(q)
        if self.waiting >= HELD:
            self._cut()

    def _cut(self) -> None:
        q, s, d = (np.concatenate(x) for x in zip((self.queries, self.scores, self.docs), *self.more, strict=True))
        order = np.lexsort((d, s, q))
        q, s, d = q[order], s[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        self.limits[q[nth == self.k - 1]] = s[nth == self.k - 1]
        kept = nth < self.k
        self.queries, self.scores, self.docs, self.more, self.waiting = q[kept], s[kept], d[kept], [], 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, doc), by query from the best to the k-th."""
        self._cut()
        return self.queries, self.scores, self.docs
