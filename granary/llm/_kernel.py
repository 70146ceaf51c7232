"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on Arrow string buffers in place: one uint8 array of UTF-8
bytes and one int64 array of offsets for a whole block of documents, so that no
per-word or per-character Python objects are made.  Hashes are 64-bit and the
same in every process; two different strings agree with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that a dozen arrays of eight bytes each fit a worker's memory many times over; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19

_U = np.uint64
#: Odd multiplier between the steps of a hash.
_STEP = _U(0x9E3779B97F4A7C15)
#: Weights of the words in a shingle; odd, so that each counts in full.
_BASE = 0xD6E8FEB86659FD93
#: Bytes from which on a span is hashed by a library digest, not step by step.
LONG = 512
#: Numbers mixed at once.
_PIECE = 1 << 14
#: Keeps the first k of eight bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public murmur3 one); long arrays in pieces that stay in a core's cache."""
    if x.ndim == 1 and len(x) > _PIECE:
        out = np.empty(len(x), _U)
        for i in range(0, len(x), _PIECE):
            out[i : i + _PIECE] = mix64(x[i : i + _PIECE])
        return out
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of mix64."""
    x = x ^ (x >> _U(33))
    x *= _U(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x ^= x >> _U(33)
    x *= _U(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    x ^= x >> _U(33)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; zeros stand behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], by its bytes and their number alone.

    Eight bytes go in at a step and are mixed before the next, so that no pattern of symbols cancels out, as it can in a
    polynomial modulo a power of two; spans above LONG bytes take a library's digest.
    """
    n = ends - starts
    out = mix64(n.astype(_U) + _STEP)
    word = _eights(data)
    active = np.flatnonzero((n > 0) & (n <= LONG))
    at, left, value = starts[active], n[active], out[active]
    while len(active):
        value = mix64(value * _STEP + (word[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        if not more.all():
            out[active[~more]] = value[~more]
            active, at, left, value = active[more], at[more], left[more], value[more]
        at, left = at + 8, left - 8
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_eights(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """hash_spans of the eight bytes at each place, in one step; all places are hashed in a row, which is cheaper than to pick those asked for first."""
    seed = mix64(np.array([8], _U) + _STEP) * _STEP
    return mix64(_eights(data) + seed)[at]


def hash_grams(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k bytes at each place that has so many."""
    m = len(data) - k + 1
    if m <= 0:
        return np.zeros(0, _U)
    word, out = _eights(data), np.full(m, k + (seed << 32), _U)
    for at in range(0, k, 8):
        own = word[at : at + m]
        out *= _STEP
        out += own if k - at >= 8 else own & _MASKS[k - at]
        out = mix64(out)
    return out


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a string column, nulls as empty."""
    column = string_column(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with at most limit bytes, or one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for i, j in blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def class_table(pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in pairs:
        out[low : high + 1] = True
    return out


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ ; every byte of a multi-byte character is one.
NOT_SPACE = ~class_table([(0x20, 0x20), (0x09, 0x0D)])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of table's bytes; none crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the document in which each position lies."""
    return np.searchsorted(offsets, starts, side="right") - 1


def word_shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of lower-cased text, the document of each, and words per document.

    A document of 1 to n - 1 words has its whole sequence as its one shingle; one without words has none.
    """
    low = LOWER[data]
    starts, ends = words(low, offsets, table)
    doc = owners(offsets, starts)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    h = hash_spans(low, starts, ends)
    if not len(h):
        return h, doc, n_words
    total = np.zeros(len(h), _U)
    for k in range(n):  # position-dependent sum
        total[: max(0, len(h) - k)] += h[k:] * _U(pow(_BASE, k + 1, 1 << 64))
    whole = np.zeros(len(h), bool)
    if len(h) >= n:
        whole[: len(h) - n + 1] = doc[: len(h) - n + 1] == doc[n - 1 :]
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    keys, where = mix64(total[whole]), doc[whole]
    if len(short):
        extra = np.empty(len(short), _U)
        for i, d in enumerate(short):
            run = h[first[d] : first[d] + n_words[d]]
            extra[i] = np.sum(run * np.array([pow(_BASE, k + 1, 1 << 64) for k in range(len(run))], _U), dtype=_U) + _U(len(run))
        keys, where = np.concatenate((keys, mix64(extra))), np.concatenate((where, short))
        order = np.argsort(where, kind="stable")
        keys, where = keys[order], where[order]
    return keys, where, n_words


def unique_by_group(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, key) pairs, sorted by group, then key; groups are numbers from 0, keys hashes.

    One number holds the group above the key's upper bits, so that one sort is enough, unless different keys of a group agree in those.
    """
    if not len(keys):
        return keys, group
    bits = int(group.max()).bit_length()
    both = keys if not bits else (group.astype(_U) << _U(64 - bits)) | (keys >> _U(bits))
    order = np.argsort(both)
    both, keys, group = both[order], keys[order], group[order]
    if ((both[1:] == both[:-1]) & (keys[1:] != keys[:-1])).any():
        order = np.lexsort((keys, group))
        keys, group = keys[order], group[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])
    return keys[fresh], group[fresh]
