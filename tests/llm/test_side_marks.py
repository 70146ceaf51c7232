from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import _anchors, substring_dedup
from granary.llm._packed import exchange

from . import brute


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([(12, 4), (13, 4), (9, 4), (20, 3), (7, 6), (16, 16)]), st.sampled_from([b"ab", b"abcdefgh"]))
def test_contexts_that_share_a_window_agree_in_a_mark(seed, sizes, some):
    rng, (window, k) = random.Random(seed), sizes
    base = [rng.choice(some) for _ in range(3 * window)]
    rows = [bytes(rng.choice(some) if rng.random() < 0.05 else c for c in base[rng.randrange(window) :]) for _ in range(3)]
    data, offs = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    grams, place, first, last = _anchors.anchored_places(data, offs, window, k)
    marks = list(zip(*_anchors.side_marks(grams, place, first, last, window, k), strict=True))
    own = [{data[s : s + window].tobytes() for s in range(a, z + 1)} for a, z in zip(first, last, strict=True)]
    for i in range(len(own)):
        for j in range(i):
            if grams[place[i]] == grams[place[j]] and own[i] & own[j]:
                assert any(x and x == y for x, y in zip(marks[i], marks[j], strict=True))


def test_contexts_that_share_an_anchor_only_are_not_asked_for(spark):
    def corpus(shared):
        rng = random.Random(5)
        return [(i, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + shared + " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))) for i in range(60)]

    def asked(docs):
        refs = spark.createDataFrame(docs, "ref long, text string")
        anchors = exchange(substring_dedup.find_anchors(refs, 100, 4), 4)
        return substring_dedup.match_contexts(anchors, 4, 1 << 14).where("kind = 2").count()

    assert asked(corpus(" the quick brown fox jumps over the lazy dog ")) == 0
    docs = corpus(" the quick brown fox jumps over the lazy dog and then it runs off to the far woods and sleeps there until the morning ")
    assert asked(docs) > 0
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(docs)
