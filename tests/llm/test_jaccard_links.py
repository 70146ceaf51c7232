from __future__ import annotations

import random

import pytest

from granary.llm import jaccard_join

from . import brute
from .test_operators import corpus, frame


def family(seed: int, start: int, n: int, share: float) -> list[tuple[int, str]]:
    """Copies of one text, each edited at random: most of them link with most others."""
    rng = random.Random(seed)
    base = [f"v{seed}w{i}" for i in range(80)]
    return [(start + i, " ".join(w if rng.random() > share else f"e{i}{k}" for k, w in enumerate(base))) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    docs = corpus(3, 60) + family(1, 1000, 40, 0.01) + family(2, 2000, 30, 0.02) + [(3000, family(1, 0, 1, 0.01)[0][1])]
    assert len({i for i, _ in docs}) == len(docs)
    sets = {i: brute.shingles(t) for i, t in docs}
    different = set(sets.values())
    count = {s: sum(1 for o in different if o != s and brute.similar(s, o)) for s in different}
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(frame(spark, docs)).collect()}
    wanted = {i: (c, count[sets[i]]) for i, (_, c) in brute.jaccard(docs).items()}
    assert max(n for _, n in wanted.values()) > 15
    assert got == wanted
