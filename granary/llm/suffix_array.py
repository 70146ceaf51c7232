"""Suffix arrays by induced sorting, recursive at every alphabet, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Places of the array that a step of the induction looks at first; it grows while buckets don't feed one another.
WINDOW = 4096
#: Bytes of a leftmost-S substring that are sorted as one word.
WORD = 7


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (S type); the last one is not, as the end is smallest."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    less, differ = t[:-1] < t[1:], t[:-1] != t[1:]
    # Within a run of one symbol the type is that of the run's last suffix.
    at = np.where(differ, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    known = nearest < n
    out[:-1][known] = less[nearest[known]]
    return out


def leftmost(types: np.ndarray) -> np.ndarray:
    """Places of the leftmost S-type suffixes."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def _put(out: np.ndarray, free: np.ndarray, p: np.ndarray, c: np.ndarray, down: bool) -> None:
    """Suffixes p to the next free places of their buckets c, in order; downwards from the bucket's end, or upwards."""
    if not len(p):
        return
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    count = np.diff(np.append(first, len(c)))
    step = np.arange(len(c)) - np.repeat(first, count)
    at = np.repeat(free[c[first]], count)
    out[at - 1 - step if down else at + step] = p
    free[c[first]] += -count if down else count


def _run(out: np.ndarray, free: np.ndarray, c: int, held: np.ndarray, fits: np.ndarray, t: np.ndarray, down: bool) -> None:
    """Suffixes that a bucket induces into itself, from those it holds: one more symbol of a run at a step."""
    while len(held):
        p = held[held > 0] - 1
        held = p[fits[p] & (t[p] == c)]
        n = len(held)
        if down:
            out[free[c] - n : free[c]] = held[::-1]
            free[c] -= n
        else:
            out[free[c] : free[c] + n] = held
            free[c] += n


def induce(t: np.ndarray, k: int, lms: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost S-type ones; in true order where lms is.  rising: types by place.

    Buckets are passed in order, as many at a step as don't feed one another: one of them in a small alphabet, hundreds in a large one.
    """
    n = len(t)
    start = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=k))))
    out = np.full(n, -1)
    tails = start[1:].copy()
    _put(out, tails, lms[::-1], t[lms[::-1]], True)
    heads, falling = start[:-1].copy(), ~rising
    _put(out, heads, np.array([n - 1]), t[n - 1 :], False)
    low, window = 0, WINDOW
    while low < k:  # larger suffixes, from the front
        high = max(low + 1, int(np.searchsorted(start, start[low] + window, "right")) - 1)
        source = out[start[low] : start[high]]
        source = source[source > 0]
        keep = falling[source - 1]
        bucket, p = t[source[keep]], source[keep] - 1
        c = t[p]
        least = np.minimum.accumulate(c)
        fed = np.flatnonzero(least <= bucket)
        if len(fed):
            high = int(least[fed[0]])
            window = max(256, 2 * int(start[high] - start[low]))
            if high == low:
                _run(out, heads, low, out[start[low] : heads[low]], falling, t, False)
                high = low + 1
                source = out[start[low] : start[high]]
                p = source[source > 0] - 1
                p = p[falling[p]]
                p = p[t[p] > low]
            else:
                p = p[bucket < high]
            c = t[p]
        else:
            window *= 2
            high = min(high, int(least[-1])) if len(c) else high  # empty buckets may be fed, too
        _put(out, heads, p, c, False)
        low = high
    out[(out >= 0) & rising[out]] = -1
    tails, high, window = start[1:].copy(), k, WINDOW
    while high > 0:  # smaller suffixes, from the back
        low = min(high - 1, int(np.searchsorted(start, start[high] - window, "left")))
        source = out[start[low] : start[high]][::-1]
        source = source[source > 0]
        keep = rising[source - 1]
        bucket, p = t[source[keep]], source[keep] - 1
        c = t[p]
        most = np.maximum.accumulate(c)
        fed = np.flatnonzero(most >= bucket)
        if len(fed):
            low = int(most[fed[0]]) + 1
            window = max(256, 2 * int(start[high] - start[low]))
            if low == high:
                low = high - 1
                _run(out, tails, low, out[tails[low] : start[high]][::-1], rising, t, True)
                source = out[start[low] : start[high]][::-1]
                p = source[source > 0] - 1
                p = p[rising[p]]
                p = p[t[p] < low]
            else:
                p = p[bucket >= low]
            c = t[p]
        else:
            window *= 2
            low = max(low, int(most[-1]) + 1) if len(c) else low
        _put(out, tails, p, c, True)
        high = low
    return out


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings, in text order, from their places in sorted order."""
    rank = np.empty(len(t), np.int64)
    rank[lms] = np.arange(len(lms))
    nxt = np.append(lms[1:], len(t))[rank[order]]
    length = nxt - order
    same = np.zeros(len(order), bool)
    same[1:] = (length[1:] == length[:-1]) & (nxt[1:] < len(t)) & (nxt[:-1] < len(t))
    active, d = np.flatnonzero(same), 0
    while len(active):
        equal = t[order[active] + d] == t[order[active - 1] + d]
        same[active[~equal]] = False
        active = active[equal]
        active = active[length[active] > d]
        d += 1
    name = np.cumsum(~same) - 1
    out = np.empty(len(lms), np.int64)
    out[rank[order]] = name
    return out, int(name[-1]) + 1


def byte_names(t: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """As _names, of a text of bytes, whose leftmost-S substrings are short: sorted by their first bytes in a word, longer ones of equal words as strings.

    A substring that begins another one is the larger of the two, as it ends in an S-type symbol; the last one ends with the text and is the smaller.
    """
    length = np.append(lms[1:] + 1, len(t)) - lms
    padded = np.concatenate((t, np.zeros(WORD, t.dtype)))
    key = np.zeros(len(lms), np.uint64)
    for j in range(WORD):
        c = padded[lms + j].astype(np.uint64)
        c[:-1][length[:-1] <= j] = 255
        key = key << np.uint64(8) | c
    whole = length <= WORD
    whole[-1] = False
    key = key << np.uint64(8) | np.where(whole, 255 - length, 0).astype(np.uint64)
    longer = np.flatnonzero(~whole)
    text = [t[a:z].tobytes().decode("latin-1") + "\u0100" for a, z in zip(lms[longer].tolist(), (lms + length)[longer].tolist(), strict=True)]
    text[-1] = text[-1][:-1]
    rank = np.zeros(len(lms), np.int64)
    number = {x: k for k, x in enumerate(sorted(set(text)))}
    rank[longer] = [number[x] for x in text]
    order = np.argsort(key)
    order[~whole[order]] = longer[np.lexsort((rank[longer], key[longer]))]
    key, rank = key[order], rank[order]
    name = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])))) - 1
    out = np.empty(len(lms), np.int64)
    out[order] = name
    return out, int(name[-1]) + 1


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Start of each suffix of t, in order; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    k = int(t.max()) + 1 if k is None else k
    types = classify(t)
    lms = leftmost(types)
    if len(lms) > 1 and t.dtype == np.uint8:
        names, count = byte_names(t, lms)
        order = lms[suffix_array(names, count) if count < len(lms) else np.argsort(names)]
    elif len(lms) > 1:
        mark = np.zeros(n, bool)
        mark[lms] = True
        order = induce(t, k, lms, types)
        order = order[mark[order]]
        names, count = _names(t, lms, order)
        order = lms[suffix_array(names, count)] if count < len(lms) else order
    else:
        order = lms
    return induce(t, k, order, types)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of data[a:] and data[b:] for each pair, eight bytes at a step."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    word = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    left = n - np.maximum(a, b)
    active = np.flatnonzero(left > 0)
    while len(active):
        done = out[active]
        x = word[a[active] + done] ^ word[b[active] + done]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) >> 3)
        out[active] = np.minimum(done + same, left[active])
        active = active[(x == 0) & (out[active] < left[active])]
    return out


def permuted_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in the text: the common prefix of each suffix and the one before it in order.

    Only where the bytes before the two differ is it compared; elsewhere it is one less than at the place before.
    """
    n = len(data)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    fresh[1:] |= data[:-1] != data[np.maximum(before[1:] - 1, 0)]
    places = np.flatnonzero(fresh)
    value = np.zeros(len(places), np.int64)
    some = before[places] >= 0
    value[some] = common_prefixes(data, places[some], before[places[some]])
    nearest = np.cumsum(fresh) - 1
    return value[nearest] - (at - places[nearest])
