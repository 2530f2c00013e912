"""Content-defined anchors: the same window has the same anchor wherever it stands."""

from __future__ import annotations

import numpy as np

from .common import POWERS, mix, prefix_hash

_PLACE = np.uint64((1 << 30) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchored(codes: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` codes within one document, and the anchor of each.

    The anchor is the leftmost gram of least hash among the window's grams of
    ``gram`` codes, so it depends on the window's content alone.  Returns the
    windows' starts, their anchors' places, all grams' hashes and the prefix hashes.
    """
    size = len(codes)
    prefix = prefix_hash(codes)
    if size < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), prefix
    begin = np.arange(size - gram + 1)
    grams = gram_hashes(prefix, gram)
    least = sliding_min((grams & ~_PLACE) | begin.astype(np.uint64), width - gram + 1)
    ok = np.ones(size - width + 1, bool)
    for a, b in zip(first[:-1], first[1:]):
        ok[max(a, b - width + 1) : b] = False
    start = np.flatnonzero(ok)
    return start, (least[start] & _PLACE).astype(np.int64), grams, prefix


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of every ``gram`` consecutive codes: good enough to choose a place, not to tell texts apart."""
    n = len(prefix) - gram
    return mix((prefix[gram:] - prefix[:n]) * POWERS.down[:n] + np.uint64(gram))
