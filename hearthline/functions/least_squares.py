"""Dense solve for one group of periods, from its summed normal equations.

A pair of periods is an edge between two periods, so the normal matrix is a weighted
graph Laplacian. Its rank follows from the connected components, without a numerical
threshold, and each component is solved on its own. The size is the number of calendar
periods, never the number of rows.
"""

from __future__ import annotations

import numpy as np


def components(size: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Smallest period index reachable from each period."""
    labels = np.arange(size)
    while True:
        low = np.minimum(labels[first], labels[second])
        merged = labels.copy()
        np.minimum.at(merged, first, low)
        np.minimum.at(merged, second, low)
        merged = merged[merged]
        if np.array_equal(merged, labels):
            return labels
        labels = merged


class PeriodSystem:
    """Normal equations of one group: edges between periods with weight and mean change."""

    def __init__(self, size, first, second, weight, mean):
        used = weight > 0
        first, second, weight, mean = first[used], second[used], weight[used], mean[used]
        self.size = size
        matrix = np.zeros((size, size))
        np.add.at(matrix, (first, first), weight)
        np.add.at(matrix, (second, second), weight)
        np.subtract.at(matrix, (first, second), weight)
        np.subtract.at(matrix, (second, first), weight)
        moment = np.zeros(size)
        np.add.at(moment, second, weight * mean)
        np.subtract.at(moment, first, weight * mean)
        self.matrix, self.moment = matrix, moment
        self.labels = components(size, first, second)
        self.rank = size - len(np.unique(self.labels))

    def _groups(self):
        roots, counts = np.unique(self.labels, return_counts=True)
        for root, count in zip(roots, counts):
            if count > 1:
                yield root, np.flatnonzero(self.labels == root)

    def solve(self) -> np.ndarray:
        """Least-squares coefficients, first period 0, of smallest norm where not unique."""
        beta = np.zeros(self.size)
        for root, nodes in self._groups():
            free = nodes[1:]
            part = np.linalg.solve(self.matrix[np.ix_(free, free)], self.moment[free])
            if root == 0:
                beta[free] = part
            else:
                beta[free] = part
                beta[nodes] -= beta[nodes].mean()
        return beta

    def inverse_diagonal(self, ridge: float | None) -> np.ndarray:
        """Diagonal of the inverse normal matrix without its first period.

        With a ridge, a component not linked to the first period gets its exact, very
        large value; without one it has no inverse and comes back NaN.
        """
        diagonal = np.full(self.size, np.nan if ridge is None else 1.0 / ridge)
        diagonal[0] = 0.0
        for root, nodes in self._groups():
            if root == 0:
                free = nodes[1:]
                block = self.matrix[np.ix_(free, free)]
                diagonal[free] = np.diag(np.linalg.inv(block + (ridge or 0.0) * np.eye(len(free))))
            elif ridge is not None:
                share = np.full((len(nodes), len(nodes)), 1.0 / len(nodes))
                spread = np.linalg.inv(self.matrix[np.ix_(nodes, nodes)] + share) - share
                diagonal[nodes] = np.diag(spread) + 1.0 / (ridge * len(nodes))
        return diagonal

    def inverse(self) -> np.ndarray | None:
        """Inverse with a zero row and column for the first period, or None if singular."""
        if self.rank < self.size - 1:
            return None
        full = np.zeros((self.size, self.size))
        full[1:, 1:] = np.linalg.inv(self.matrix[1:, 1:])
        return full
