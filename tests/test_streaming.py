from __future__ import annotations

import json

from granary.streaming import stream_records


def test_each_key_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i, text: json.dumps({"source_index": i, "at": "2024-01-01T00:00:00", "value": json.dumps({"text": text})})
    (folder / "a.json").write_text("\n".join([row(1, "a b"), row(1, "a b"), row(2, "c")]) + "\n")
    query = stream_records(spark, str(folder)).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        (folder / "b.json").write_text(row(2, "c") + "\n" + row(3, "d e f") + "\n")
        query.processAllAvailable()
        got = spark.sql("SELECT source_index, token_count, bucket FROM records ORDER BY source_index").collect()
    finally:
        query.stop()
    assert [tuple(r) for r in got] == [(1, 2, 128), (2, 1, 128), (3, 3, 128)]
