"""Order of the rows of a small matrix by complete-linkage clustering, for heat maps; the matrix is one that fits a screen."""

from __future__ import annotations

import numpy as np


def complete_linkage_order(matrix: np.ndarray) -> list[int]:
    """Row numbers as the leaves of the tree stand from left to right; missing values count as 0.

    The two clusters whose furthest rows are nearest merge first; at a tie, those with the smaller first rows.
    """
    values = np.nan_to_num(np.asarray(matrix, float))
    if not len(values):
        return []
    gaps = np.sqrt(((values[:, None] - values[None]) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    leaves = [[k] for k in range(len(values))]
    for _ in range(len(values) - 1):
        a, b = sorted(divmod(int(gaps.argmin()), len(values)))
        leaves[a] += leaves[b]
        gaps[a] = np.maximum(gaps[a], gaps[b])
        gaps[:, a] = gaps[a]
        gaps[a, a] = np.inf
        gaps[b], gaps[:, b] = np.inf, np.inf
    return leaves[0]
