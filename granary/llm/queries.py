"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .curriculum import mix_sources
from .decontamination import find_leaks
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .minhash_dedup import minhash_components
from .mpeg_audio import media_features
from .prefix_trie import prefix_trie
from .quality_ranking import score_quality
from .secret_scan import scan_secrets
from .spelling import group_variants
from .substring_dedup import remove_repeats
from .warc import archive_and_read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.char_length("kept").cast("long").alias("n_chars_kept"))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("raw")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read_table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("n_links")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_ranking": op3_quality_ranking,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scan": op10_secret_scan,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

#: The CRC-32 of a hex string h's bytes, with its table t.
SQL_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"
SQL_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
dup AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM dup),
island AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z FROM island GROUP BY doc_id, k),
gaps AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(gaps.z, len(h) // 2) - a)), '' ORDER BY a) AS rest FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    # Similar lines by an exact prefix filter, not by signatures.
    "op2_line_dedup": r"""
WITH RECURSIVE raw AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
l AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[ \t\x0B\x0C\r]+', ''), '[ \t\x0B\x0C\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM raw),
u AS (SELECT s, hex(encode(s)) AS h, row_number() OVER (ORDER BY s) AS id FROM (SELECT DISTINCT s FROM l WHERE s <> '')),
g AS (SELECT DISTINCT id, unnest(CASE WHEN len(h) < 16 THEN [h] ELSE list_transform(range(0, len(h) // 2 - 7), lambda k: substr(h, 2 * k + 1, 16)) END) AS x FROM u),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
f AS (SELECT x, count(*) AS df FROM g GROUP BY x HAVING count(*) > 1),
o AS (SELECT g.id, n.n, hash(g.x) AS x, row_number() OVER (PARTITION BY g.id ORDER BY coalesce(df, 1), g.x) AS r FROM g JOIN n USING (id) LEFT JOIN f USING (x)),
pre AS (SELECT id, n, x FROM o WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.id < b.id AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
met AS (SELECT a, b, count(*) AS c FROM cand JOIN g p ON p.id = a JOIN g q ON q.id = b AND q.x = p.x GROUP BY a, b),
links AS (SELECT a, b FROM met JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT id, least(id, coalesce(min(b), id)) AS root FROM u LEFT JOIN reach ON a = id GROUP BY id),
m AS (SELECT l.*, s <> '' AS solid, s <> '' AND row_number() OVER (PARTITION BY coalesce(root, -1) ORDER BY doc_id, i) > 1 AS gone FROM l LEFT JOIN u USING (s) LEFT JOIN root USING (id))
SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (solid AND gone)), '')) AS kept_sha256, length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (solid AND gone)), '')) AS n_chars_kept
FROM m GROUP BY doc_id""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
q AS (SELECT *, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to, url,
  '<urn:capture:request:' || page_id || '>' AS request_id, '<urn:capture:metadata:' || page_id || '>' AS metadata_id
FROM q""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
  (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, coalesce(least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight), cap) AS target FROM l),
r AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS words, CAST(CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE -0.5 END AS DOUBLE) AS slope,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM r),
n AS (SELECT *, CAST(size * passes + greatest(0, least(size, words - passes * source_size - start)) AS BIGINT) AS taken, least(1, start / greatest(target, 1)) AS x FROM k)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
  CASE WHEN taken > 0 THEN round(least(1, 2 * x / (1 - slope + sqrt(greatest(0, (1 - slope) * (1 - slope) + 4 * slope * x)))), 9) ELSE 2 END AS position
FROM n""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
    "op11_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM c""",
    "op12_prefix_trie": r"""
WITH RECURSIVE """ + SQL_CRC_TABLE + r""",
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, """ + SQL_CRC + r""" % 9 AS h FROM (SELECT c, hex(encode(CAST(c AS VARCHAR))) AS h FROM (SELECT DISTINCT c FROM o)), crc),
r AS (SELECT l.c, k, role, text FROM l JOIN o ON o.c = l.c - l.c % 5 AND k < h UNION ALL SELECT l.c, k, role, text FROM l JOIN o ON o.c = l.c AND k >= h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, strlen(text) AS bytes, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS m FROM r),
p AS (SELECT c, d, bytes, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS path FROM t UNION ALL SELECT c, 0, 0, '' FROM l),
e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
n AS (SELECT d, path, min(p.c) AS c, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (d = last), '') AS ends FROM p JOIN e ON e.c = p.c GROUP BY d, path),
k AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT substr(path, 1, 32 * i) AS path, n_children, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f)),
s AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY path)
SELECT f.c AS conv_id, f.d AS depth, g.c AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN f g ON f.d > 0 AND g.path = substr(f.path, 1, 32 * (f.d - 1))""",
    "op13_spelling": r"""
WITH RECURSIVE """ + SQL_CRC_TABLE + r""",
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS runs FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(runs) AS run FROM d) GROUP BY ALL),
c AS (SELECT run, n, """ + SQL_CRC + r""" AS h FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS h FROM r), crc),
s AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
w AS (SELECT word, unnest(range(0, length(word))) AS k FROM v),
x AS (SELECT DISTINCT word, k, substr(word, 1, k) || '*' || substr(word, k + 2) AS wild, substr(word, 1, k) || substr(word, k + 2) AS shorter FROM w),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.wild = b.wild AND a.k = b.k AND a.word <> b.word
  UNION SELECT word, shorter FROM x SEMI JOIN v ON v.word = x.shorter UNION SELECT shorter, word FROM x SEMI JOIN v ON v.word = x.shorter),
best AS (SELECT a, count(*) AS n_near, min_by(b, (-n, b)) AS b, max(n) AS n FROM p JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN b END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON a = v.word),
walk(word, root) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL) r ON r.word = f.word""",
}
