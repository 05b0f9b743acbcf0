"""Rows in reach of a number and the least id among them, in sorted blocks: what a block of two sides is compared with instead of all its pairs."""

from __future__ import annotations

import numpy as np


def in_reach(values: np.ndarray, at: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """For each number the first place, and the one after the last, of the ascending values that lie at most gap of the larger one away from it.

    Bounds by division are corrected by the gap itself, as it is taken of pairs, a value and all its copies at a time.
    """
    def fits(k: np.ndarray) -> np.ndarray:
        v = values[np.clip(k, 0, len(values) - 1)]
        return (k >= 0) & (k < len(values)) & (np.abs(at - v) / np.maximum(at, v) <= gap)

    first, last = np.searchsorted(values, at * (1 - gap), "left"), np.searchsorted(values, at / (1 - gap), "right") - 1
    every = lambda k, side: np.searchsorted(values, values[np.clip(k, 0, len(values) - 1)], side)
    if not len(values):
        return first, first
    while (more := fits(first - 1)).any():
        first = np.where(more, every(first - 1, "left"), first)
    while (less := (first <= last) & ~fits(first)).any():
        first = np.where(less, every(first, "right"), first)
    while (more := fits(last + 1)).any():
        last = np.where(more, every(last + 1, "right") - 1, last)
    while (less := (first <= last) & ~fits(last)).any():
        last = np.where(less, every(last, "left") - 1, last)
    return first, np.maximum(first, last + 1)


class Least:
    """Places of the least of any run of some numbers, from two overlapping runs whose lengths are powers of two."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.runs = numbers, [np.arange(len(numbers))]
        while 2 << (len(self.runs) - 1) <= len(numbers):
            half, last = 1 << (len(self.runs) - 1), self.runs[-1]
            a, b = last[:-half], last[half:]
            self.runs.append(np.where(numbers[b] < numbers[a], b, a))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """first < end."""
        size, out = np.frexp(end - first)[1] - 1, np.empty(len(first), np.int64)
        for k in np.unique(size):
            some = size == k
            a, b = self.runs[k][first[some]], self.runs[k][end[some] - (1 << int(k))]
            out[some] = np.where(self.numbers[b] < self.numbers[a], b, a)
        return out
