"""Content-defined anchors: equal strings have equal anchors, wherever they stand."""

from __future__ import annotations

import numpy as np

from ._kernel import hash_grams, mix64

_U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each x[i : i + width]."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[:n], out[width - size : width - size + n])
    return out[:n]


def anchored_places(data: np.ndarray, offsets: np.ndarray, window: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: (hashes of all k-grams, anchor's place, first start, last start).

    A window's anchor is the k-gram of it whose hash's upper half is least, the leftmost of equal ones,
    so it depends on the window alone.  Windows that would cross two documents belong to no run.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return np.zeros(0, _U), none, none, none
    grams = hash_grams(data, k, seed)
    packed = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    place = (sliding_min(packed, window - k + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    n = len(place)
    delta = np.zeros(n + 1, np.int32)
    ends = offsets[1:-1]
    np.add.at(delta, np.clip(ends - window + 1, 0, n), 1)
    np.add.at(delta, np.minimum(ends, n), -1)
    inside = np.cumsum(delta[:n]) == 0
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside)
    return grams, place[first], first, last


def anchored_runs(data: np.ndarray, offsets: np.ndarray, window: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first start, last start) of each run."""
    grams, place, first, last = anchored_places(data, offsets, window, k, seed)
    return grams[place], first, last


def side_marks(grams: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of a hash of the bytes right before each run's anchor, and of those right behind it; 0 where the run has too few.

    A window has window - k bytes beside its anchor: more than half of them before it, or at least half behind.  So runs of
    one anchor that share a window agree in a mark that isn't 0.
    """
    behind = window - k - (window - k) // 2
    before = window - k + 1 - behind
    out = []
    for size, has, step in ((before, place - first, -1), (behind, last + window - place - k, 1)):
        mark = np.zeros(len(place), np.uint32)
        some = np.flatnonzero(has >= size)
        own = np.zeros(len(some), _U)
        for j in range(0, size, k):  # the k-grams from the far end up to the anchor; the last one may reach into it
            own = mix64(own * _U(3) + grams[place[some] + step * (size - j)])
        mark[some] = np.maximum(own >> _U(32), _U(1))
        out.append(mark)
    return out[0], out[1]
