from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, rank long, best string, k1 long, size int"


def frame(spark, rows):
    """Documents with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "w", 1, 2, "b", 3, 4) for i, t in rows], SCHEMA)


def brute(rows, least=5, occurrences=3, modulus=97):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    count: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        found = sorted((-words[x], x) for x in words if near(w, x))
        best = found[0] if found and -found[0][0] >= 2 * n else None
        form[w] = best[1] if best else None
        out[w] = (n, len(found), -best[0] if best else None)
    result = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result[w] = (form[w], root, *out[w])
    return result


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed=1, n=300):
    rng = random.Random(seed)
    stems = ["spelling", "variant", "Frequent", "occurrence", "écrire", "naïvely", "abcde", "aabbcc", "there", "their", "three"]
    weights = [2 ** (k % 7) for k in range(len(stems))]
    letters = "abcdeé×"

    def word():
        w = rng.choices(stems, weights)[0]
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k] + w[k:]))
        return w

    return [(i, rng.choice((" ", "-", "\n", "9")).join(word() for _ in range(rng.randint(1, 90)))) for i in range(n)]


def test_variants_match_brute_force(spark):
    rows = texts()
    want = brute(rows)
    assert len(want) > 100 and sum(x[0] is not None for x in want.values()) > 20 and any(x[1] != x[0] and x[0] for x in want.values())
    assert found(spelling.group_variants(frame(spark, rows))) == want


def test_a_smaller_modulus_changes_more(spark):
    rows = texts(2, 60)
    assert found(spelling.group_variants(frame(spark, rows), modulus=3, occurrences=1)) == brute(rows, occurrences=1, modulus=3)


def test_edges(spark):
    long = "q" * 60_000
    rows = [(None, "alpha alpha"), (None, "alpha Alpha ALPHA"), (3, None), (4, ""), (5, "alphas " * 4), (5, "alphas " * 4), (6, f"{long} {long}x {long} {long}"), (7, f"{long}x {long}x"), (8, "1 2 3 āāāāā")]
    got = found(spelling.group_variants(frame(spark, rows)))
    assert got == brute(rows)
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, None), (2, "a b c")])).count() == 0


def test_ties_take_the_first_in_code_point_order(spark):
    rows = [(1, "woruz " * 3 + "worud " * 9 + "worub " * 9 + "worué " * 9)]
    got = found(spelling.group_variants(frame(spark, rows), modulus=1 << 40))
    assert got["woruz"] == ("worub", "worub", 3, 3, 9) and got["worub"] == (None, "worub", 9, 3, None)


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_pieces_end_between_runs(size):
    t = "ab cde  fghijklm n " * 3
    got = list(spelling.pieces(t, size))
    assert "".join(got) == t and [x for p in got for x in spelling.RUN.findall(p)] == spelling.RUN.findall(t)


def test_forms_along_a_chain(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(50, 40)], "rank long, form long")
    got = {r.rank: r.root for r in spelling.last_forms(chain).collect()}
    assert got == {k + 1: 0 for k in range(20)} | {50: 40}
