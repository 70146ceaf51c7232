from __future__ import annotations

import random

import numpy as np

from granary.llm import minhash_dedup as mh

from . import brute
from .test_operators import collected, corpus

SCHEMA = "doc_id long, text string, n long, class long, sig string, bands int, key long, rep int, label string"


def frame(spark, rows):
    """Documents with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, 2, "s", 3, 4, 5, "l") for i, t in rows], SCHEMA)


def wanted(docs, percent=85):
    sets = {i: brute.shingles(t) for i, t in docs}
    r = brute.roots(sets, lambda x, y: brute.similar(sets[x], sets[y], percent))
    return {i: (len(s), r[i], r[i] == i) for i, s in sets.items()}


def found(df):
    return collected(df, "doc_id", "n_shingles", "component_id", "kept")


def test_components_match_brute_force(spark):
    docs = corpus(11, 90)
    assert found(mh.minhash_components(frame(spark, docs))) == wanted(docs)


def edited(rng, base, rate):
    return " ".join(w if rng.random() > rate else f"e{rng.random()}" for w in base)


def test_a_family_without_a_common_leader(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 5)
    monkeypatch.setattr("granary.llm.jaccard_join.BLOCK_DOCS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, edited(rng, base, 0.015)) for i in range(60)]
    want = wanted(docs)
    assert 3 < len({x[1] for x in want.values()}) < 50  # some link, many don't
    assert found(mh.minhash_components(frame(spark, docs))) == want


def test_one_stray_does_not_compare_a_family_with_itself(spark, monkeypatch):
    """Of many linked copies and one that links with a later copy only, what is laid out grows with the copies, not with their square."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(200) for k in [rng.randrange(400)]]
    far = list(base)
    for k in range(5, 400, 33):
        far[k] = f"y{k}"
    near = list(far)
    near[200] = "z"
    docs += [(500, " ".join(far)), (501, " ".join(near))]
    laid = []
    own = mh.lay_out_cells
    monkeypatch.setattr(mh, "lay_out_cells", lambda left: laid.append(left.count()) or own(left))
    assert found(mh.minhash_components(frame(spark, docs))) == wanted(docs)
    assert laid[0] <= 202


def test_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A B c d e f"), (6, None), (7, ""), (8, "x"), (9, " \n"), (10, "long " * 150_000), (11, "Long " * 150_000 + "tail"), (12, "X")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in mh.minhash_components(frame(spark, rows)).collect())
    assert got == [(-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 2, 11, True), (12, 1, 8, False)]
    assert mh.minhash_components(frame(spark, [])).count() == 0
    assert found(mh.minhash_components(frame(spark, [(1, None), (2, " ")]))) == {1: (0, 1, True), 2: (0, 2, True)}


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.0, 0.3, 0.6, 0.85, 1.0):
        for _ in range(40):
            n = 400
            common = round(n * 2 * j / (1 + j))
            keys = rng.integers(0, 1 << 64, 2 * n, np.uint64)
            a, b = np.sort(keys[:n]), np.sort(np.concatenate((keys[:common], keys[n : 2 * n - common])))
            sig, _ = mh.signatures(np.concatenate((a, b)), np.array([0, n]))
            errors.append(float(mh.estimated(mh.differing(sig[0], sig[1]))) - common / (2 * n - common))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.17


def test_the_estimate_turns_away_no_pair_at_the_threshold():
    for percent in (80, 85, 95):
        p, most = (1 - percent / 100) * (1 - mh.BY_CHANCE), mh.most_differing(percent)
        from math import comb

        assert sum(comb(mh.MINIMA, k) * p**k * (1 - p) ** (mh.MINIMA - k) for k in range(most + 1, mh.MINIMA + 1)) <= mh.MISS
    assert mh.most_differing(100) == 0
    assert 0.5 < mh.estimated(np.array(mh.most_differing(85))) < 0.7
