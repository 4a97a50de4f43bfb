"""Spanning forests of links found inside one task, so that groups leave it without all their pairs."""

from __future__ import annotations

import numpy as np


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the least node that the links left[i]-right[i] connect each one to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            onward = label[label]
            if np.array_equal(onward, label):
                break
            label = onward
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


class Forest:
    """Collects links between n nodes in bounded memory."""

    def __init__(self, n: int, bound: int = 1 << 20):
        self.n, self.bound = n, bound
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.held += len(left)
        if self.held > self.bound:
            self.reduce()

    def reduce(self) -> None:
        if not self.left:
            return
        label = roots(self.n, np.concatenate(self.left), np.concatenate(self.right))
        child = np.flatnonzero(label != np.arange(self.n))
        self.left, self.right, self.held = [child], [label[child]], 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from each node to the least one of its tree, fewer than n of them."""
        self.reduce()
        return (self.left[0], self.right[0]) if self.left else (np.zeros(0, np.int64), np.zeros(0, np.int64))
