from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import buckets, tensors, text


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("Dr. Smith came. He left.", "Dr. Smith came."),
        ("U.S! x", "U.S! x"),
        ("No. Five", "No."),
        ("No. 5 is. b", "No. 5 is."),
        ("Wait.... More", "Wait...."),
        ("a...b. c", "a...b."),
        ("..", "."),
        ("foo.a.b c. d", "foo.a."),
        ("etc! ok. z", "etc! ok."),
        ("Pi is 3.14. Yes.", "Pi is 3.14."),
        ("J. Smith spoke. Then.", "J. Smith spoke."),
        ("J. smith spoke.", "J."),
        ("", ""),
        ("  no mark \x85", "no mark"),
    ],
)
def test_first_sentence(given_text, expected):
    assert text.first_sentence_of(given_text) == expected


@given(st.text(alphabet="aB1.!? N\n", max_size=40))
def test_first_sentence_is_a_prefix(value):
    out = text.first_sentence_of(value)
    assert value.strip().startswith(out)
    assert text.first_sentence_of(out) in (out, text.first_sentence_of(out))


def test_strip_and_marker_cut(spark):
    rows = [("\x0b\x1c　a b\xa0\x1f",), ("yes Question: no",), ("\nA: b",), ("see http://x",), (None,), ("",), (" . REF",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.strip(F.col("t")).alias("s"), text.marker_cut(F.col("t")).alias("m")).collect()
    for r in got:
        if r.t is None:
            assert r.s is None and r.m is None
            continue
        assert r.s == r.t.strip()
        cut = min([r.t.find(m) for m in text.MARKERS if m in r.t], default=len(r.t))
        assert r.m == (r.t[:cut].strip() or r.t.strip())


def test_truncated_answer_falls_back_to_the_whole(spark):
    got = spark.createDataFrame([("\nOne. Two",)], "t string").select(text.truncate_answer(F.col("t"))).first()[0]
    assert got == "One."


def test_prompts(spark):
    r = spark.createDataFrame([(" c ", " q ")], "c string, q string").select(text.qa_prompt(F.col("c"), F.col("q")), text.summary_prompt(F.col("c"))).first()
    assert r[0].split("\n")[1:] == [" Context:c", " Question:q", " Answer:"]
    assert r[1].split("\n")[1:] == ["Document:c", "Summary:"]


def test_two_parts():
    assert text.two_parts("/a/b/") == ("a", "b")
    for bad in ("a", "a/b/c", "a//b", ""):
        with pytest.raises(ValueError):
            text.two_parts(bad)


def test_buckets(spark):
    b, cut = buckets.assign_bucket(F.col("n"), (128, 256, 512))
    got = spark.createDataFrame([(1,), (128,), (129,), (700,)], "n int").select("n", b, cut).collect()
    assert [tuple(r) for r in got] == [(1, 128, 0), (128, 128, 0), (129, 256, 0), (700, 512, 188)]
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(0,)], "n int").select(b).collect()
    for bad in ((), (0, 1), (2, 1), (1, 1)):
        with pytest.raises(ValueError):
            buckets.checked_buckets(bad)
    assert buckets.normalized_buckets([4, 2, 4]) == (2, 4)


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([1, 2, 3, 4, 5],)], "t array<int>")
    got = df.select(buckets.pad_left(F.col("t"), 4, F.lit(0)), buckets.attention_mask(F.col("t"), 4)).collect()
    assert [tuple(r) for r in got] == [([0, 1, 2, 3], [0, 1, 1, 1]), ([0, 0, 0, 0], [0, 0, 0, 0]), ([2, 3, 4, 5], [1, 1, 1, 1])]


def test_tensors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([[3.0, 4.0], [1.0, 0.0]],), ([[1.0, nan], [inf, 0.0]],)], "s array<array<float>>")
    got = df.select(tensors.offending_layers(F.col("s")), tensors.has_shape(F.col("s"), (2, 2)), tensors.has_shape(F.col("s"), (2, 3))).collect()
    assert [tuple(r) for r in got] == [([], True, False), ([0, 1], True, False)]
    with pytest.raises(Exception, match="finite in layers 0,1"):
        df.select(tensors.require_finite(F.col("s"))).collect()
    v = df.limit(1).select(tensors.rms_norm(F.element_at("s", 1), 0.0, F.array(F.lit(1.0), F.lit(2.0)))).first()[0]
    assert v == pytest.approx([3 / math.sqrt(12.5), 8 / math.sqrt(12.5)])
    own, states = tensors.split_layers(F.col("s"))
    r = df.limit(1).select(own, states, tensors.last_position(F.col("s"))).first()
    assert (r[0], r[1], r[2]) == ([3.0, 4.0], [[1.0, 0.0]], [1.0, 0.0])
    m = spark.createDataFrame([({0: 1.0, 1: 2.0},), ({0: 1.0, 2: 2.0},)], "m map<int, double>").select(tensors.complete_layers(F.col("m"), 2)).collect()
    assert [x[0] for x in m] == [True, False]


def test_bfloat16(spark):
    got = spark.createDataFrame([([1.0, 1.00390625, 1.01171875, float("inf")],)], "v array<float>").select(tensors.to_bfloat16(F.col("v"))).first()[0]
    assert got == [1.0, 1.0, 1.015625, float("inf")]


def test_all_bfloat16_values_make_a_round_trip():
    import numpy as np

    from granary.functions import tensors

    bits = np.arange(1 << 16).astype(np.uint16)
    back = tensors.bfloat16_bits(tensors.bfloat16_floats(bits))
    nan = ((bits & 0x7F80) == 0x7F80) & ((bits & 0x7F) != 0)
    assert np.array_equal(back[~nan], bits[~nan]) and np.isnan(tensors.bfloat16_floats(back[nan])).all()
    assert np.array_equal(tensors.bfloat16_finite(bits), np.isfinite(tensors.bfloat16_floats(bits)))
    between = np.array([1.00390625, 1.01171875, 1.004, 3.4e38, -1.01171875], np.float32)  # ties go to the even neighbour
    assert tensors.bfloat16_floats(tensors.bfloat16_bits(between)).tolist() == [1.0, 1.015625, 1.0078125, float("inf"), -1.015625]


def test_packed_vectors(spark):
    from pyspark.sql import functions as F

    from granary.functions import tensors

    rows = [(1, [0.5, -2.0, 1.0]), (2, []), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf")])]
    df = spark.createDataFrame(rows, "id long, v array<float>").select("id", tensors.pack_bfloat16("v").alias("p"))
    got = {r.id: (r.n, r.f, r.v) for r in df.select("id", F.octet_length("p").alias("n"), tensors.packed_finite("p").alias("f"), tensors.unpack_bfloat16("p").alias("v")).collect()}
    assert got[1] == (6, True, [0.5, -2.0, 1.0]) and got[2] == (0, True, []) and got[3] == (None, None, None)
    assert got[4][:2] == (4, False) and got[5][:2] == (2, False)


def test_rms_norm_in_bfloat16():
    import numpy as np

    from granary.functions import tensors

    x, w = np.random.default_rng(1).standard_normal((5, 64)).astype(np.float32), np.linspace(0.5, 2, 64)
    plain = x / np.sqrt((x.astype(float) ** 2).mean(axis=1, keepdims=True) + 1e-5)
    assert np.allclose(tensors.rms_norm_rows(x), plain, rtol=1e-5) and np.allclose(tensors.rms_norm_rows(x, weight=w), plain * w, rtol=1e-5)
    cast = lambda v: tensors.bfloat16_floats(tensors.bfloat16_bits(np.asarray(v, np.float32)))
    assert np.array_equal(tensors.rms_norm_rows(x, weight=w, bfloat16=True), cast(cast(w) * cast(tensors.rms_norm_rows(x))))


def naive_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_match_the_plain_rule():
    import random

    from granary.functions.tokenizer import merge_piece

    rng = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    for k in range(60):
        ranks.setdefault(b"".join(rng.choice([t for t in ranks if t.isalpha() and t < b"e"][:40]) for _ in range(2)), 256 + k)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
        assert merge_piece(piece, ranks) == naive_merges(piece, ranks)
    assert len(merge_piece(b"ab" * 200_000, ranks)) > 1  # no square


def test_token_ids_match_a_public_library(spark):
    import base64
    import os

    import pytest

    from granary.functions.tokenizer import PIECES, merge_ids, read_ranks

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world, it's 2024!", "naïve café — ÆØÅ 漢字 _x_y", "", "a\n\n  b\t", "pneumonoultramicroscopic" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string")
    got = {r.id: r.ids for r in df.select("id", merge_ids(spark, read_ranks(spark, path))("t").alias("ids")).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts] and got[len(texts)] == []


def test_a_vocabulary_must_be_whole(spark, tmp_path):
    import base64

    import pytest

    from granary.functions import tokenizer

    (tmp_path / "v").write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(255)))
    with pytest.raises(ValueError, match="1 single bytes"):
        tokenizer.read_ranks(spark, str(tmp_path / "v"))
