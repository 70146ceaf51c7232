"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACE = b" \t\n\x0b\x0c\r"


def repeats(docs: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, m in zip(b, gone, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(t: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if len(w) >= n:
        return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def roots(nodes, linked) -> dict:
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(nodes)
    for x in order:
        for y in order:
            if x < y and linked(x, y):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def similar(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def jaccard(docs) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    r = roots(sets, lambda x, y: similar(sets[x], sets[y]))
    return {i: (len(s), r[i]) for i, s in sets.items()}


def lines(docs, k: int = 8) -> dict[int, tuple[int, int, str]]:
    places, sets = [], {}
    for i, t in sorted(docs):
        at = 0
        for line in (t or "").encode().split(b"\n"):
            n = bytes(c + 32 if 65 <= c <= 90 else c for c in line).strip(SPACE)
            if n:
                places.append(((i, at), n))
                sets[i, at] = frozenset(n[j : j + k] for j in range(len(n) - k + 1)) if len(n) >= k else frozenset([n])
            at += len(line) + 1
    r = roots(sets, lambda x, y: similar(sets[x], sets[y]))
    out = {}
    for i, t in docs:
        at, keep, n, gone = 0, [], 0, 0
        for line in (t or "").encode().split(b"\n"):
            n += (i, at) in sets
            if (i, at) in sets and r[i, at] != (i, at):
                gone += 1
            else:
                keep.append(line)
            at += len(line) + 1
        out[i] = (n, gone, b"\n".join(keep).decode())
    return out


def secrets(t: str | None) -> tuple[int, int, int, str]:
    t = t or ""
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = [(m.start(), 0, m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(x[1] == k for x in found) for k in range(3)), base)


def licenses(t: str | None) -> tuple[int, int, int | None, int | None, str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(j, label) for j in range(len(w)) if w[j : j + len(p)] == p]
    starts = [j for j, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def align(a: list, b: list) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best
