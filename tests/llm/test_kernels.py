from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import _anchors, _kernel, _packed, decontamination, license_scan, mpeg_audio, suffix_array

from . import brute

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\tZ.", max_size=60)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 4), st.booleans())
def test_suffix_array(data, fold, few):
    t = np.frombuffer(data * fold, np.uint8)
    t = t % np.uint8(3) if few else t
    sa = suffix_array.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    if len(t):
        common = suffix_array.permuted_prefixes(t, sa)
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = next((k for k in range(len(t) - max(x, y)) if t[x + k] != t[y + k]), len(t) - max(x, y))
            assert common[y] == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 400))
def test_suffix_array_of_large_alphabets(values, stretch):
    t = np.array(values) * stretch * 7
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix_array.suffix_array(t).tolist() == want
    types = suffix_array.classify(t)
    lms = suffix_array.leftmost(types)
    order = np.array(sorted(lms.tolist(), key=lambda i: t[i:].tolist()), np.int64)
    assert suffix_array.induce(t, int(t.max()) + 1, order, types).tolist() == want


def test_suffix_array_recurses_by_induction():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(4000)]
    t = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 4000, 9000)), np.uint8)
    sa = suffix_array.suffix_array(t, 256)
    raw = t.tobytes()
    assert sorted(sa.tolist()) == list(range(len(t)))
    assert all(raw[x:] < raw[y:] for x, y in zip(sa[:-1:97].tolist(), sa[1::97].tolist(), strict=False))


@settings(max_examples=60, deadline=None)
@given(texts)
def test_word_shingles(rows):
    data, offs = _kernel.buffers(pa.array(rows, pa.string()))
    keys, doc, n_words = _kernel.word_shingles(data, offs, 5)
    keys, doc = _kernel.unique_by_group(keys, doc)
    assert np.bincount(doc, minlength=len(rows)).tolist() == [len(brute.shingles(t)) for t in rows]
    own = [frozenset(keys[doc == d].tolist()) for d in range(len(rows))]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert len(own[i] & own[j]) == len(brute.shingles(a) & brute.shingles(b))


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"one two one two one", np.uint8)
    h = _kernel.hash_spans(data, np.array([0, 8, 16, 4]), np.array([3, 11, 19, 7]))
    assert h[0] == h[1] == h[2] != h[3]
    assert (_kernel.unmix64(_kernel.mix64(h)) == h).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=2, max_size=12), st.integers(1, 20))
def test_hashes_tell_spans_apart(rows, k):
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.cumsum([len(r) for r in rows])
    h = _kernel.hash_spans(data, ends - [len(r) for r in rows], ends).tolist()
    assert all((a == b) == (x == y) for a, x in zip(h, rows, strict=True) for b, y in zip(h, rows, strict=True))
    grams, own = _kernel.hash_grams(data, k).tolist(), [data[i : i + k].tobytes() for i in range(len(data) - k + 1)]
    assert len(grams) == len(own) and len(set(grams)) == len(set(own))


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_hashes_of_words_that_cancel_out_in_polynomials():
    for n in (64, 512, 1024, 4096):
        rows = [thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, "abcdefgh", "ABCDEFGH"), thue_morse(n, "ABCDEFGH", "abcdefgh")]
        data, offs = _kernel.buffers(pa.array(rows))
        assert len(set(_kernel.hash_spans(data, offs[:-1], offs[1:]).tolist())) == 4
        keys, doc, _ = _kernel.word_shingles(data, offs)
        assert len(set(keys.tolist())) == 3  # the last two are equal in lower case


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=5))
def test_anchored_runs_partition_windows(rows):
    data = np.frombuffer(b"".join(rows), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    key, first, last = _anchors.anchored_runs(data, offs, 12, 4)
    starts = [p for a, z in zip(first, last, strict=True) for p in range(a, z + 1)]
    assert starts == [p for a, z in zip(offs[:-1], offs[1:], strict=True) for p in range(a, z - 11)]
    owner = {}
    for k, a, z in zip(key.tolist(), first, last, strict=True):
        for p in range(a, z + 1):
            assert owner.setdefault(data[p : p + 12].tobytes(), k) == k


def test_packing():
    part = np.array([2, 0, 2], np.int32)
    rows = list(_packed.deal(0, part, [np.array([1, 2, 3]), np.array([4, 5, 6], np.int32)]))
    assert [(k, p) for k, p, _ in rows] == [(0, 0), (0, 2)]
    a, b = _packed.unpack([x for _, _, x in rows], ["<i8", "<i4"])
    assert (a.tolist(), b.tolist()) == ([2, 1, 3], [5, 4, 6])


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=4000), st.binary(max_size=20))
def test_mpeg_round_trip(payload, junk):
    stored = mpeg_audio.store_payload(payload)
    s = mpeg_audio.parse_stream(stored)
    assert mpeg_audio.read_payload(stored, s) == payload
    assert s.crc_bad == 0 and s.crc_good == len(s.offsets) + 1 and s.skipped == 0
    assert s.vbr["frames"] == len(s.offsets) and s.samples == 1152 * len(s.offsets)


def test_mpeg_round_trip_of_marks_at_all_offsets():
    for mark in (b"TAG", b"ID3\x03\0\0\0\0\0\x10", b"Xing\0\0\0\x0f", b"\xff\xfa\x90\x00", b"\xff\xfb\x90\x64"):
        for at in range(140):
            for size in (192, 448, 1984):
                payload = bytearray(b"x" * size)
                payload[size - 140 + at : size] = (mark + b"x" * 140)[: 140 - at]
                payload = bytes(payload)
                stored = mpeg_audio.store_payload(payload)
                assert mpeg_audio.read_payload(stored, mpeg_audio.parse_stream(stored)) == payload


def test_mpeg_resynchronisation_and_damage():
    stored = mpeg_audio.store_payload(bytes(range(250)) * 30)
    s = mpeg_audio.parse_stream(stored)
    cut = s.offsets[2]
    broken = stored[:cut] + b"\xff\x00junk\xff" + stored[cut:]
    again = mpeg_audio.parse_stream(broken)
    assert len(again.offsets) == len(s.offsets) and again.skipped == 7
    flipped = bytearray(stored)
    flipped[s.offsets[1] + 10] ^= 1  # in the side information
    assert mpeg_audio.parse_stream(bytes(flipped)).crc_bad == 1
    assert mpeg_audio.parse_stream(stored + b"TAG" + bytes(125)).tags["TAG"][:3] == b"TAG"
    assert mpeg_audio.parse_stream(b"").offsets == [] and mpeg_audio.parse_stream(b"\xff" * 50).offsets == []


def test_mpeg_damage_that_looks_like_a_header():
    stored = mpeg_audio.store_payload(bytes(range(250)) * 30)
    s = mpeg_audio.parse_stream(stored)
    cut = s.offsets[2]
    junk = b"\0\0" + stored[cut : cut + 4] + bytes(5)
    again = mpeg_audio.parse_stream(stored[:cut] + junk + stored[cut:])
    assert again.offsets == s.offsets[:2] + [x + len(junk) for x in s.offsets[2:]]
    assert (again.skipped, again.samples, again.crc_bad) == (len(junk), s.samples, 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
def test_matching_statistics(templates, stream):
    auto = license_scan.Automaton()
    for k, x in enumerate(templates):
        auto.add(x, k)
    parts = {tuple(x[i:j]) for x in templates for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for i, (state, n) in enumerate(auto.statistics(stream)):
        assert n == max((k for k in range(i + 2) if k == 0 or tuple(stream[i + 1 - k : i + 1]) in parts), default=0)
        for template, place in auto.ends[state].items():
            assert templates[template][place + 1 - n : place + 1] == stream[i + 1 - n : i + 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 6), min_size=1, max_size=12), st.lists(st.integers(2, 6), min_size=1, max_size=25))
def test_alignment(item, passage):
    a, b = np.array([item + [0, 0]], np.uint64), np.array([passage + [1]], np.uint64)
    score, begin, end = (int(x[0]) for x in decontamination.align(a, b))
    assert score == brute.align(item, passage)
    if score:
        assert brute.align(item, passage[begin:end]) == score


def test_eight_bytes_at_once_hash_as_spans():
    data = np.random.default_rng(2).integers(0, 256, 500).astype(np.uint8)
    at = np.array([0, 3, 491, 492])
    assert np.array_equal(_kernel.hash_eights(data, at), _kernel.hash_spans(data, at, at + 8))
    from granary.llm import line_dedup

    a, z = np.array([0, 20, 40, 60]), np.array([7, 28, 41, 90])
    gram, line = line_dedup._grams(data, a, z, 8)
    want = [(s, min(s + 8, e)) for s0, e in zip(a, z, strict=True) for s in range(s0, max(s0, e - 8) + 1)]
    assert np.array_equal(gram, _kernel.hash_spans(data, *map(np.array, zip(*want, strict=True)))) and line.tolist() == [0, 1, 2] + [3] * 23
