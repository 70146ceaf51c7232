"""Texts above a block, repeated rows, null ids and empty tables, for all operators and all stages of the pipeline."""

from __future__ import annotations

import hashlib
import random

import pytest

from granary.llm import _kernel, curriculum, jaccard_join, license_scan, line_dedup, minhash_dedup, mpeg_audio, quality_ranking, secret_scan, substring_dedup, warc

from . import brute
from .test_operators import WORDS, collected, frame


@pytest.fixture(scope="module")
def long_docs():
    """A text of more than a block, an edited copy of it, and short ones."""
    rng = random.Random(21)
    words = [rng.choice(WORDS) + rng.choice(("", "s", "ed", "x", "y")) + str(rng.randrange(60)) for _ in range(90_000)]
    text = " ".join(words)
    assert len(text) > _kernel.BLOCK_BYTES
    words[50_000] = "edited"
    secret = ' token = "a1b2c3d4e5f6a7b8" mit license'
    return [(1, text + secret), (2, " ".join(words) + " end"), (3, "short " + text[:400]), (4, None), (5, "a mit license\nb")]


def test_long_texts_in_repeats(spark, long_docs):
    assert collected(substring_dedup.remove_repeats(frame(spark, long_docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(long_docs)


def test_long_texts_in_lines(spark, long_docs):
    assert collected(line_dedup.dedup_lines(frame(spark, long_docs)), "doc_id", "n_lines", "n_removed", "kept") == brute.lines(long_docs)


def test_long_texts_in_joins(spark, long_docs):
    want = brute.jaccard(long_docs)
    assert want[2][1] == 1 and collected(jaccard_join.jaccard_components(frame(spark, long_docs)), "doc_id", "n_shingles", "component_id") == want
    assert collected(minhash_dedup.minhash_components(frame(spark, long_docs)), "doc_id", "n_shingles", "component_id") == want


def test_long_texts_in_scans(spark, long_docs):
    assert collected(license_scan.scan_licenses(frame(spark, long_docs)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == {i: brute.licenses(t) for i, t in long_docs}
    got = collected(secret_scan.scan_secrets(frame(spark, long_docs)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == {i: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for i, t in long_docs for x in [brute.secrets(t)]}


def test_long_texts_in_mixes_scores_and_frames(spark, long_docs):
    sizes = {i: (len((t or "").split()),) for i, t in long_docs}
    assert collected(curriculum.mix_sources(frame(spark, long_docs)), "doc_id", "size") == sizes
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_ranking.score_quality(frame(spark, long_docs), labels).collect())
    for r in mpeg_audio.media_features(frame(spark, long_docs)).collect():
        b = (dict(long_docs)[r.doc_id] or "").encode()
        assert r.n_bytes == len(b) and r.payload_sha256 == hashlib.sha256(b + bytes(-len(b) % 64 or 64 * (not b))).hexdigest()


def test_long_pages_in_archives(spark, long_docs):
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in [*long_docs, (6, long_docs[0][1])]], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()}
    for i, t in [*long_docs, (6, long_docs[0][1])]:
        b = (t or "").encode()
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), *(("revisit", 6) if i == 1 else ("response", None)))


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """The same results where nothing may be broadcast: one payload on many pages, one secret in many documents."""
    body = "<p>" + "x" * 1200
    pages = spark.createDataFrame([(i, f"http://h/{i}", body if i % 3 else f"{body}{i}") for i in range(60)] + [(None, "u", body)], "page_id long, url string, html string")
    docs = frame(spark, [(i, f"key{i} token=Zx9Qw8Er7T password=sample{i % 2}pw1") for i in range(60)])
    own = lambda: (sorted(map(str, warc.archive_and_read(pages).collect())), sorted(map(str, secret_scan.scan_secrets(docs).collect())))
    want = own()
    for module in ("jaccard_join", "prefix_trie"):
        monkeypatch.setattr(f"granary.llm.{module}.fits_broadcast", lambda table: False)
    assert own() == want and sum("revisit" in x for x in want[0]) == 39  # but the holder and the null id


def test_repeated_rows_and_null_ids(spark):
    text = "the mit license token=abcdefgh12\nline of some length here\nline of some length here"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "other words")]
    n = lambda df: sorted(((r.doc_id is not None, r.doc_id or 0) for r in df.collect()))
    ids = sorted((i is not None, i or 0) for i, _ in rows)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert n(got) == ids and {(r.doc_id, r.n_removed) for r in got.collect()} == {(None, 1), (None, 0), (1, 3), (2, 0)}
    got = license_scan.scan_licenses(frame(spark, rows))
    assert n(got) == ids and sorted((r.n_words, r.n_base) for r in got.collect()) == [(0, 0), (2, 0), (15, 1), (15, 1), (15, 1)]
    got = mpeg_audio.media_features(frame(spark, rows))
    assert n(got) == ids and len({r.media_sha256 for r in got.collect()}) == 3
    assert n(secret_scan.scan_secrets(frame(spark, rows))) == ids
    assert n(minhash_dedup.minhash_components(frame(spark, rows))) == ids


def test_licenses_of_one_word_and_of_later_paragraphs(spark):
    rows = [(1, "under the unlicense here"), (2, "Unlicense"), (3, "unlicense unlicense mit license"), (4, "nothing"), (5, None)]
    got = collected(license_scan.scan_licenses(frame(spark, rows), phrases=(*license_scan.PHRASES, ("unlicense", "unl"))), "doc_id", "n_base", "first_word", "last_word", "base_labels")
    assert got == {1: (1, 2, 2, "unl"), 2: (1, 0, 0, "unl"), 3: (3, 0, 2, "mit,unl"), 4: (0, None, None, ""), 5: (0, None, None, "")}
    got = collected(license_scan.scan_licenses(frame(spark, rows), templates=(*license_scan.TEMPLATES, ("unl", "unlicense"))), "doc_id", "labels", "score")
    assert got[1] == ("unl", 1.0) and got[2] == ("unl", 1.0) and got[3] == ("mit,unl", 1.0) and got[4] == ("", 0.0)
    later = [(k, "int main() {} /* " + t.lower().replace(",", " ,\n * ") + " */") for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = collected(license_scan.scan_licenses(frame(spark, later)), "doc_id", "labels", "score")
    assert all(label in got[k][0].split(",") and got[k][1] == 1.0 for k, (label, _) in enumerate(license_scan.TEMPLATES))


def tables(spark, tmp_path, items):
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_stages_with_nulls_repeats_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(40))
    own = line()
    rows = [(i, line(), "en", "a", 1) for i in range(20)] + [(50, own, "en", "a", 1), (50, own, "en", "a", 1), (None, line(), None, None, None), (60, None, "en", None, 0), (61, "", None, "b", 0)]
    tables(spark, tmp_path, [(1, own), (None, None)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", "1 AS ref", "'x' AS kept", "2 AS size", "'y' AS predicted", "3 AS rank")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, wide, str(tmp_path)).collect()
        assert k == 4 or all(tuple(r.asDict()) == corpus_pipeline.COLUMNS for r in got)
        ids = [r.doc_id for r in got]
        if name == "line_dedup":
            assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
        if name == "near_duplicates":
            assert sorted(map(str, ids)) == sorted({str(r[0]) for r in rows})
        if name == "decontamination":
            assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows if r[0] != 50)
        if name == "mixing":
            assert all(r.taken > 0 for r in got) and 60 not in ids and 61 not in ids


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [])
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
