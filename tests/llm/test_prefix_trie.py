from __future__ import annotations

import hashlib
import math
import random
import zlib

from granary.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, up string, n_convs int, ordinal long, node string"


def frame(spark, rows):
    """Conversations with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "u", 2, 3, "n") for r in rows], SCHEMA)


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = {p for p in under if len(p) == len(path) + 1}
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) > len(p) for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = sorted(c for c in members if len(built[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out[min(members), len(path)] = (parent, len(members), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("yes", "no", "é" * 5, "", None))))
    rng.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark):
    rows = conversations(1, 60, 14)
    got = found(trie.prefix_trie(frame(spark, rows)))
    assert got == brute(rows) and max(x[1] for x in got.values()) > 10


def test_long_copies_are_rolled_up_over_all_levels(spark):
    turns = [f"turn {k}" for k in range(70)]
    rows = [(c, k, "user", t) for c in (0, 5, 10, 11) for k, t in enumerate(turns[: 70 - (c == 10) * 20])] + [(15, k, "user", t if k < 41 else "other") for k, t in enumerate(turns)]
    assert found(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_edges(spark, monkeypatch):
    rows = conversations(3, 12, 5)
    rows += [(None, 1, "user", "lost"), (3, None, "user", "b"), (3, None, "user", "a"), (3, None, None, None), (3, 2, "user", "same"), (3, 2, "user", "same")]
    rows += [(-3, 1, "user", "yes"), (-5, 0, "user", "no"), (201, 0, "user", "x" * 300_000), (202, 0, "user", "x" * 300_000), (200, 0, "user", "x" * 300_000)]
    monkeypatch.setattr("granary.llm.prefix_trie.fits_broadcast", lambda table: False)
    assert found(trie.prefix_trie(frame(spark, rows))) == {**brute(rows)}
    assert trie.prefix_trie(frame(spark, [])).count() == 0
    assert trie.prefix_trie(frame(spark, [(None, 0, "user", "a")])).count() == 0


def test_many_end_at_one_node(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(5 * c, 0, "user", "hello") for c in range(100)] + [(5 * c + 1, 0, "user", "hello") for c in range(0, 40, 2)]
        assert found(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
