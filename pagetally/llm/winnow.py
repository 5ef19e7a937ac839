"""Anchors chosen by content, so that equal windows of any two texts hold the same anchor at the same place."""
from __future__ import annotations

import numpy as np

from .common import Runs

_PLACE = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def spans(runs: Runs, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` symbols within texts, in runs that have the same anchor.

    The anchor of a window is its run of `gram` symbols with the least hash, the last of those that tie. `at`: where the
    texts begin. Returns for each run of windows: where the first begins, how many there are, where their anchor
    begins, and the anchor's hash. Each window is in exactly one run; on random text a run has some half of
    (length - gram) windows.
    """
    n = int(at[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    grams = runs.every(gram)
    place = _PLACE - np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(grams & ~_PLACE | place, length - gram + 1)
    change = np.zeros(n - length + 2, np.int32)
    whole = np.flatnonzero(np.diff(at) >= length)
    np.add.at(change, at[whole], 1)
    np.add.at(change, at[whole + 1] - length + 1, -1)
    begins = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(begins):
        return none, none, none, np.zeros(0, np.uint64)
    anchors = (_PLACE - (least[begins] & _PLACE)).astype(np.int64)
    new = np.ones(len(begins), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (begins[1:] != begins[:-1] + 1)
    first = np.flatnonzero(new)
    return begins[first], np.diff(np.append(first, len(begins))), anchors[first], grams[anchors[first]]
