from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import curriculum, decontamination, jaccard_join, license_scan, line_dedup, mpeg_audio, quality_ranking, secret_scan, substring_dedup, warc

from . import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, part int, ref string, blob string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "r", "b") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "x"]) for _ in range(k))
    shared = [line(30) for _ in range(3)]
    docs = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not docs:
            t = "\n".join(line(rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        elif kind == 3:
            t = rng.choice(docs)[1] or ""
        elif kind == 4:
            w = (rng.choice(docs)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        else:
            t = line(8) + "\n" + rng.choice(shared) + "\n" + line(6)
        docs.append((i * 3, t))
    return [*docs, (1, None), (2, ""), (4, "é" * 400), (5, "ab " * 2000), (7, "tiny"), (8, "one two three four"), (10, "One two  three four"), (11, "\n\n \n")]


def collected(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_repeats_match_brute_force(spark):
    docs = corpus()
    want = brute.repeats(docs)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collected(substring_dedup.remove_repeats(frame(spark, docs)), *columns) == want
    hot = substring_dedup.remove_repeats(frame(spark, docs), hot=1, shard_bytes=500, kept=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in hot} == want
    for r in hot:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeats_of_equal_ids(spark):
    a, b = "x" * 40 + " first " * 30, "y" * 40 + " first " * 30
    got = substring_dedup.remove_repeats(frame(spark, [(1, a), (1, a), (None, a), (2, b)]))
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got.collect())
    assert rows[1] == rows[2] == (True, 1, len(a))  # the null id comes first
    assert rows[0][2] < len(a) and 0 < rows[3][2] < len(b)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_jaccard_matches_brute_force(spark):
    docs = corpus(2, 90)
    assert collected(jaccard_join.jaccard_components(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)


def test_jaccard_family_without_a_common_leader(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(w if rng.random() > 0.02 else f"e{i}{k}" for k, w in enumerate(base))) for i in range(60)]
    got = jaccard_join.jaccard_components(frame(spark, docs))
    assert collected(got, "doc_id", "n_shingles", "component_id") == brute.jaccard(docs)


def test_one_stray_costs_each_member_one_place(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 100)
    reps = spark.range(2000).select(F.col("id").alias("ref"), F.lit(5).cast("long").alias("n"), F.lit(1).cast("long").alias("gid"), F.when(F.col("id") == 77, 77).otherwise(0).cast("long").alias("known"))
    cells = jaccard_join.lay_out_cells(reps)
    assert cells.count() < 2 * 2000 and cells.where("ref = 77").select("j").distinct().count() == 20
    met = cells.where("ref <> 77").join(cells.where("ref = 77").select("g", "k", "i", "j"), ["g", "k", "i", "j"], "left_semi")
    assert met.select("ref").distinct().count() == 1999
    assert jaccard_join.lay_out_cells(reps.where("ref <> 77")).count() == 0
    lone = jaccard_join.lay_out_cells(reps.withColumn("known", F.col("ref")).where("ref < 250"))  # nobody is linked: every pair meets
    pairs = lone.alias("a").join(lone.alias("b"), ["g", "k", "i", "j"]).where("a.ref < b.ref").select(F.col("a.ref").alias("x"), F.col("b.ref").alias("y")).distinct()
    assert pairs.count() == 250 * 249 // 2


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A B c d e f"), (6, None), (7, ""), (8, "x")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8)]
    kept = jaccard_join.keep_one(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["6", "7", "8", "None"] and kept[0].source == "s"
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_lines_match_brute_force(spark):
    docs = corpus(3, 60) + [(500, "The same line of text here.\nthe SAME line of text here. \nanother line"), (501, "The same line of text hers.\nx\nX")]
    got = collected(line_dedup.dedup_lines(frame(spark, docs), keep=("source",)), "doc_id", "n_lines", "n_removed", "kept")
    assert got == brute.lines(docs)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))).capitalize() + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! ")) for i in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_ranking.score_quality(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 400]
    assert np.mean(right) > 0.97
    none = quality_ranking.score_quality(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality_ranking.score_quality(frame(spark, []), labels).count() == 0


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, "word " * (i % 9 + 1)) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = lambda y: spark.createDataFrame([(i, (i % 2) ^ (y if i in held else 0)) for i in range(60)], "doc_id long, quality int")
    a, b = (collected(quality_ranking.score_quality(frame(spark, rows), labels(y)), "doc_id", "score") for y in (0, 1))
    assert a == b


def test_repeated_rows_teach_once(spark):
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = lambda i: "A plain sentence of words." if i % 2 else "LOUD!! " * (5 + i % 7)
    rows = [(i, text(i)) for i in free[:40]]
    labels = spark.createDataFrame([(i, i % 2) for i in free[:40]], "doc_id long, quality int")
    plain = collected(quality_ranking.score_quality(frame(spark, rows), labels), "doc_id", "score")
    assert len({*plain.values()}) > 1
    least = free[0]
    for many in ([(least, text(least))] * 120, [(least, text(least) + f" {k}!") for k in range(120)]):
        got = quality_ranking.score_quality(frame(spark, rows + many), labels, train_rows=40)
        scores = collected(got, "doc_id", "score", "predicted")
        assert all(scores[i][1] == i % 2 for i in free[1:40])
    got = quality_ranking.score_quality(frame(spark, rows + [(least, text(least))] * 120), labels, train_rows=40)
    assert collected(got, "doc_id", "score") == plain


def test_warc(spark):
    big, page = "<p>" + "é" * 600 + "</p>", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "<p>"), (4, "http://d\r\nX: y", "<p>"), (5, "", None), (6, "http://f", page), (7, "http://g", big), (8, "u", "z" * 999), (9, "u", "z" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        holder = max(k for k, _, h in rows if h == html) if len(b) >= 1000 else i
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if holder == i else ("revisit", holder))
        assert got[i].request_id == f"<urn:capture:request:{i}>" and got[i].metadata_id == f"<urn:capture:metadata:{i}>"
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://{i}", chr(233) * (i * 50)) for i in range(40)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert {r.response.url: bytes(r.response.payload).decode() for r in got} == {u: h for _, u, h in rows}
    assert all(r.response.intact and r.request.head.startswith("GET") for r in got)


def test_warc_headers_of_any_length(spark, tmp_path):
    ok, body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n", b"hello"
    blocks = [ok + b"X-Long: " + b"y" * 70000 + b"\r\n\r\n" + body, ok + b"\r\n" + body, ok + b"X-Cut: z"]
    record = lambda i, b: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, hashlib.sha1(body).hexdigest().encode(), len(b)) + b + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(blocks)))
    got = {r.record_id: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert [(bytes(got[f"<r:{i}>"].payload), got[f"<r:{i}>"].intact) for i in range(3)] == [(body, True), (body, True), (b"", False)]
    assert [len(got[f"<r:{i}>"].head) for i in range(3)] == [len(blocks[0]) - 5, len(blocks[1]) - 5, len(blocks[2])]


def test_licenses(spark):
    rows = corpus(4, 20) + [(900, "Released under the MIT License. mit\nlicense, Mit-License"), (901, "Licensed under the Apache License, Version 2.0."), (902, "GNU General Public License"), (903, "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"), (904, "mit licenses; apache\x00license é license")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[903].labels == "mit" and got[903].base_labels == "" and got[901].score == 1
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_licenses_at_several_places(spark):
    notice, other = "This work is licensed under the GNU General Public License, version 3.", "some code in between that is no licence at all and goes on"
    rows = [(1, f"{notice} {other} {notice}\n{notice} {other}")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert [(x.start, x.end) for x in got[1].spans if x.label == "gpl" and x.cover == 1] == [(0, 12), (25, 37), (37, 49)]
    again = license_scan.scan_licenses(frame(spark, [(2, "four five six one two three")]), templates=(("t", "one two three four five six one two three"),), cover=0.6).collect()
    assert [(x.start, x.end, round(x.cover, 3)) for x in again[0].spans] == [(0, 6, 0.667)]
    split = license_scan.scan_licenses(frame(spark, [(3, "four five six q one two three")]), templates=(("t", "one two three w four five six z one two three"),), cover=0.5).collect()
    assert split[0].labels == "t" and [(x.start, x.end) for x in split[0].spans] == [(0, 7)]


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "é", None])) for i in range(300)] + [(300, None, "a"), (301, "w w", "only"), (None, "w", "a"), (7, "w w w", "b"), (7, "w w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1)).withColumn("piece", F.lit("x"))
    got = curriculum.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * sizes[s]}
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert len(r.positions) == (-(-r.taken // r.size) if r.taken else 0) and all(0 <= p <= 1 for p in r.positions)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = curriculum.mix_sources(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.position)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert curriculum.mix_sources(df.limit(0)).count() == 0


def test_pipeline_gives_the_positions_of_all_passes(spark):
    import corpus_pipeline

    rows = [(i, "w " * (i % 9 + 1), "en", "small" if i < 20 else "large", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    assert any(r.taken > r.size for r in got)
    for r in got:
        assert len(r.positions) == -(-r.taken // r.size) and r.positions[0] == r.position and r.positions == sorted(r.positions)


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    item = lambda: [rng.choice(words) for _ in range(30)]
    items = [(k, item()) for k in range(6)]
    edited = lambda w, n: [x if j % n else "changed" for j, x in enumerate(w)]
    docs, want = [], set()
    for i in range(60):
        w = [rng.choice(words) for _ in range(80)]
        if i % 4 == 0:
            k, own = items[i % 6]
            w[20:20] = [own, edited(own, 6), own[:25]][i // 4 % 3]
            want.add((i, k))
        docs.append((i, " ".join(w).capitalize() + "."))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(9, None), (10, "")], "item_id long, text string")
    docs += [(100, None), (101, "")]
    for most in (1 << 20, 300):  # by a broadcast, by a shuffle
        got = decontamination.find_leaks(frame(spark, docs), benchmark, broadcast=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        dropped = decontamination.drop_leaks(frame(spark, docs), benchmark, broadcast=most)
        assert sorted(r.doc_id for r in dropped.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want}) and dropped.columns == frame(spark, docs).columns
    for r in got:
        own = re.findall(r"[a-z]+", dict(docs)[r.doc_id].lower())
        assert brute.align(dict(items)[r.item_id], own) / 60 == pytest.approx(r.score)
    for most in (1 << 20, 0):
        assert decontamination.find_leaks(frame(spark, []), benchmark, broadcast=most).count() == 0
        assert decontamination.find_leaks(frame(spark, docs), benchmark.limit(0), broadcast=most).count() == 0
        assert decontamination.drop_leaks(frame(spark, docs), benchmark.limit(0), broadcast=most).count() == len(docs)


def test_leaks_without_a_common_trigram(spark):
    rng = random.Random(12)
    items = [(k, [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n)]) for k, n in enumerate((30, 31, 45, 15))]
    third = lambda w: [x if j % 3 < 2 else "changed" for j, x in enumerate(w)]
    spread = lambda w: [y for j, x in enumerate(w) for y in ([x, "added"] if j % 2 else [x])]
    apart = lambda w: [y for x in w[:-1] for y in (x, "added")] + w[-1:]
    docs = [(10 * k + m, " ".join(["before"] * 5 + edit(w) + ["behind"] * 5)) for k, w in items for m, edit in enumerate((list, third, spread, apart))]
    docs += [(100 + i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60))) for i in range(40)]
    points = {(i, k): brute.align(w, t.split()) for i, t in docs for k, w in items}
    want = {key: s / (2 * len(dict(items)[key[1]])) for key, s in points.items() if s >= len(dict(items)[key[1]])}
    assert {(10 * k + m, k) for k, _ in items for m in range(4)} - {(11, 1)} <= set(want)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for most in (1 << 20, 0):
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(frame(spark, docs), benchmark, broadcast=most).collect()}
        assert got == pytest.approx(want)


def test_leaks_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(14)
    own = [f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(30)]
    benchmark = spark.createDataFrame([(None, " ".join(own)), (2, "unlicense"), (2, "unlicense")], "item_id long, text string")
    docs = [(1, "a b " + " ".join(own)), (1, "a b " + " ".join(own)), (None, " ".join(own[:29])), (3, "the Unlicense here"), (4, None), (5, ""), (6, "word " * 120_000 + " ".join(own))]
    want = sorted([(1, None), (1, None), (None, None), (3, 2), (6, None)], key=str)
    for most in (1 << 20, 0):
        assert sorted(((r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, docs), benchmark, broadcast=most).collect()), key=str) == want
        kept = decontamination.drop_leaks(frame(spark, docs), benchmark, broadcast=most)
        assert sorted(r.doc_id for r in kept.collect()) == [4, 5]


def test_rare_seeds_lose_no_copy():
    """Every alignment of the least score holds as many seeds as are asked for, whichever places are common."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(1, 1 << 63, 40, np.uint64)
    held = 0
    for _ in range(600):
        n = int(rng.integers(4, 60))
        item = vocabulary[(rng.random(n) ** 2 * 40).astype(int)]
        often = rng.integers(0, 50, 1 << decontamination.SKETCH_BITS)
        copy = [w for w in item.tolist() for w in ([] if rng.random() < 0.12 else [w] if rng.random() < 0.8 else [int(rng.integers(1 << 62)), w])]
        doc = np.array([*vocabulary[:5].tolist(), *copy, *vocabulary[5:9].tolist()], np.uint64)
        need = decontamination.needed(n, decontamination.LEAST_SCORE)
        score = int(decontamination.align(item[None], doc[None])[0][0])
        places, hits = decontamination.seed_places(item, need, often)
        if score < need or need <= decontamination.MATCH:
            continue
        pairs = {(int(a), int(b)) for d in (1, 2) for a, b in zip(doc[:-d], doc[d:], strict=True)}
        met = {int(p) for p in places for d in (1, 2) if p + d < n and (int(item[p]), int(item[p + d])) in pairs}
        assert len(met) >= hits
        held += 1
    assert held > 200


def test_leaks_of_long_and_short_items(spark):
    rng = random.Random(13)
    long = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(450)]
    short, middle = "what is the capital of france".split(), "name the three largest rivers of the old world".split()
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(middle))], "item_id long, text string")
    docs = [(0, "b b b " + " ".join(long[100:300]) + " e e"), (1, " ".join(long[7:32])), (2, " ".join(long[7:31])), (3, "so what is the matter, and the capital of nowhere"), (4, "Q: What is the capital of France?"), (5, "what is the capital of spain"), (6, "the three largest rivers of the land"), (7, "name the three big rivers of the old world")]
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in decontamination.find_leaks(frame(spark, docs), benchmark).collect()}
    assert got == {(0, 1): (pytest.approx(400 / 900), 3, 203), (1, 1): (pytest.approx(50 / 900), 0, 25), (4, 2): (1, 1, 7), (7, 3): (pytest.approx(15 / 18), 0, 9)}
    assert {r.doc_id for r in decontamination.drop_leaks(frame(spark, docs), benchmark).collect()} == {2, 3, 5, 6}


def test_mpeg_features(spark):
    rows = corpus(9, 12)
    got = {r.doc_id: r for r in mpeg_audio.media_features(frame(spark, rows), media=True).collect()}
    for i, t in rows:
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 or (64 if not b else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and len(r.seek_offsets) == r.n_frames
    assert mpeg_audio.media_features(frame(spark, [])).count() == 0


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    rows = [
        (1, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "s1", "o1"), (2, f"{key} and {key}z", "s1", "o1"), (3, "API-KEY api_key:short PASSWD='Ab3dEf9hJk2m'", "s2", "o1"),
        (4, "password password=examplepass1", "s1", "o1"), (5, "password password=examplepass1", "s2", "o2"), (6, "password password=examplepass1", "s3", "o3"),
        (7, None, None, None), (8, "", "s", "o"), (9, "ſecret=12345678 toKen:12345678 f" + "0" * 31 + "g", "s", "o"), (9, "toKEn=a1b2c3d4e5", "s", "o"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("row", F.lit(1)).withColumn("h", F.lit("x"))
    got = sorted(secret_scan.scan_secrets(df).collect(), key=lambda r: (r.doc_id, -r.n_hex))
    for r, (i, t, *_rest) in zip(got, rows, strict=True):
        *n, base = brute.secrets(t)
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (i, *n, hashlib.sha256(base.encode()).hexdigest())
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex", "")] == base.split(",")
    assert "live:" in got[0].spans and "copied:" not in got[0].spans
    assert all("copied:18:30" in r.spans and "live:" not in r.spans for r in got[3:6])
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    from granary.llm._components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (5, 6)], "a long, b long")
    assert collected(components(links), "node", "root") == {i: (0,) for i in range(41)} | {100: (100,), 101: (100,)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    line = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "x"]) for _ in range(k)).capitalize() + "."
    item = line(30)
    rows = [(i, "\n".join(line(12) for _ in range(4))) for i in range(80)]
    rows += [(100 + i, line(40).upper().replace(" ", "!! ")) for i in range(40)]
    rows += [(200, rows[0][1]), (201, line(20) + "\n" + item), (202, line(5) + "\n" + rows[1][1].split("\n")[0])]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100 or i >= 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = frame(spark, rows).select(*corpus_pipeline.COLUMNS), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append({r.doc_id: r.text for r in docs.collect()})
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert set(seen[0]) == {i for i, _ in rows if not 100 <= i < 200}
    assert set(seen[1]) == set(seen[0]) and seen[1][200] == "" and rows[1][1].split("\n")[0] not in seen[1][202]
    assert 201 in seen[2] and 201 not in seen[3] and set(seen[4]) <= set(seen[3])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])


def test_mixing_carries_columns_of_any_name(spark):
    names = ("rank", "size", "digest", "piece", "inside", "start", "passes", "piece_start", "target", "positions", "_s", "source")
    rows = [(i, f"w{i} " * (i % 4 + 1), "s" if i % 3 else None, *(f"{n}{i}" for n in names[:-1])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names[:-1]))
    plain = collected(curriculum.mix_sources(df), "doc_id", "size", "target", "taken", "position")
    got = curriculum.mix_sources(df, keep=names)
    assert collected(got, "doc_id", "size", "target", "taken", "position") == plain
    for r in got.collect():
        assert all(r[f"kept_{n}" if n in ("size", "target", "positions") else n] == f"{n}{r.doc_id}" for n in names[:-1]) and r.kept_source == r.source
