"""Steps of line_dedup whose cost must follow their input: what they return, and how often they do their dear part."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import _kernel, jaccard_join, line_dedup

_U = np.uint64


def hashes(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=_U)


def test_sparse_signatures_take_no_rounds(monkeypatch):
    """Lines of one, two and many shingles: no rounds of tries until the last empty bin is filled, which took over a thousand."""
    bins, counts = line_dedup.BANDS * line_dedup.ROWS, [1, 2, 3, 90, 1]
    gram, line = hashes(1, sum(counts)), np.repeat(np.arange(len(counts)), counts)
    line_dedup.signatures(gram, line, len(counts))
    calls, mix = [], line_dedup.mix64
    monkeypatch.setattr(line_dedup, "mix64", lambda x: (calls.append(len(x)), mix(x))[1])
    sig = line_dedup.signatures(gram, line, len(counts))
    assert len(calls) <= 8
    where = ((gram >> _U(32)) * _U(bins)) >> _U(32)
    for k in range(len(counts)):
        own: dict[int, int] = {}
        for b, g in zip(where[line == k].tolist(), gram[line == k].tolist(), strict=True):
            own[b] = min(own.get(b, 1 << 32), g & 0x7FFFFFFF)
        for b in range(bins):
            at, attempt = b, 0
            while at not in own:
                attempt += 1
                at = int(mix(np.array([b * 977 + attempt * 1_000_003], _U))[0]) % bins
            assert sig[k, b] == own[at]


@pytest.mark.parametrize("weighed", [False, True])
def test_keys_that_stand_once_are_not_ordered(monkeypatch, weighed):
    key, h = hashes(2, 20_000), np.repeat(hashes(3, 1000), 20)
    key[::400] = key[0]
    key[7::1000] = key[7]
    weight = np.arange(len(key), dtype=np.int64) % 9 if weighed else None
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), lexsort(keys))[1])
    lead, links = jaccard_join.star_links(key, h, weight)
    assert max(sizes) < len(key) // 20
    classes = {k: set() for k in key.tolist()}
    for k, c in zip(key.tolist(), h.tolist(), strict=True):
        classes[k].add(c)
    total = {c: 0 for c in h.tolist()}
    for own in classes.values():
        for c in own:
            total[c] += len(own) - 1
    heavy: dict[tuple[int, int], int] = {}
    for k, c, w in zip(key.tolist(), h.tolist(), weight.tolist() if weighed else [total[c] for c in h.tolist()], strict=True):
        heavy[k, c] = max(heavy.get((k, c), 0), w)
    first = {k: max((heavy[k, c], c) for c in own) for k, own in classes.items()}
    assert {k: (w, c) for k, c, w in zip(*(x.tolist() for x in lead), strict=True)} == first
    wanted = {(first[k][1], c) for k, own in classes.items() for c in own if c != first[k][1]}
    got = list(zip(*(x.tolist() for x in links), strict=True))
    assert len(got) == len(set(got)) and set(got) == wanted


def test_groups_of_keys_are_sorted_once(monkeypatch):
    keys, group = hashes(4, 5000), np.repeat(np.arange(50), 100)
    keys[1::2] = keys[::2]
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), lexsort(keys))[1])
    got = _kernel.unique_by_group(keys, group)
    assert list(zip(*(x.tolist() for x in got[::-1]), strict=True)) == sorted(set(zip(group.tolist(), keys.tolist(), strict=True)))
    assert not sizes
    keys = (keys >> _U(60)) + (_U(9) << _U(60))  # alike in their upper bits
    got = _kernel.unique_by_group(keys, group)
    assert list(zip(*(x.tolist() for x in got[::-1]), strict=True)) == sorted(set(zip(group.tolist(), keys.tolist(), strict=True)))


@pytest.mark.parametrize("two", [False, True])
def test_small_cells_link_as_large_ones(monkeypatch, two):
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, base = int(rng.integers(2, 12)), hashes(int(rng.integers(1 << 30)), 40)
        sets = [np.unique(np.concatenate((base[: rng.integers(20, 41)], hashes(int(rng.integers(1 << 30)), int(rng.integers(0, 6)))))) for _ in range(n)]
        sets[0] = sets[0][:0]
        side = rng.integers(0, 2, n) if two else np.zeros(n, np.int64)
        ref, known = np.arange(n) * 7, rng.integers(0, n, n) * 7
        links, degree = jaccard_join.cell_links(sets, side, ref, known, 80, two)
        monkeypatch.setattr(jaccard_join, "FEW_PAIRS", -1)
        other, count = jaccard_join.cell_links(sets, side, ref, known, 80, two)
        monkeypatch.undo()
        assert degree.tolist() == count.tolist() and len(links) == len(other)
        tied = [labels(ref, known, x) for x in (links, other)]
        assert tied[0] == tied[1]


def labels(ref, known, links) -> list[int]:
    own = dict(zip(ref.tolist(), known.tolist(), strict=True))
    for a, b in links:
        low, high = sorted((own[a], own[b]))
        own = {k: low if v == high else v for k, v in own.items()}
    return list(own.values())


def test_lines_with_any_white_space():
    rng = np.random.default_rng(7)
    space = [" ", "\t", "\r", "\x0b", " " * 31, " " * 32, " " * 33, "\t" * 80, ""]
    texts = ["", "\n", None, " " * 90, "\n\n", "a", " a\n", " " * 50 + "\n" + "x" + "\t" * 50]
    texts += ["".join(rng.choice(space + ["\n", "é", "word"], rng.integers(0, 25))) for _ in range(400)]
    data, offs = _kernel.buffers(pa.array(texts, pa.string()))
    wanted = []
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        for m in re.finditer(rb"[^\n]+", raw):
            solid = m.group().strip(b" \t\r\x0b\x0c")
            if solid:
                at = m.start() + len(m.group()) - len(m.group().lstrip(b" \t\r\x0b\x0c"))
                wanted.append((int(offs[d]) + m.start(), int(offs[d]) + at, int(offs[d]) + at + len(solid), d))
    assert list(zip(*(x.tolist() for x in line_dedup.lines_of(data, offs)), strict=True)) == wanted
