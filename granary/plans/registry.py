"""Registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, tensors
from ..functions import text as text_functions
from ..operators import integrity, packing, records
from ..sources import read_table, shared_folder
from . import config, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BATCH, SHARD, WRITERS = 8, 64, 8
# Texts that meet the sentence and marker rules which the fixture doesn't.
LITERALS = (
    "Dr. Smith came. He left.", "U.S. forces won. Next.", "U.S! x", "No. Five", "No. 5 is. b", "Wait.... More", "a...b. c", "..", "foo.a.b c. d", "etc! ok. z", "Pi is 3.14. Yes.",
    "J. Smith spoke. Then.", "J. smith spoke. Then.", "  padded. Q: next", "yes Question: no", "answer: it", "see http://x.y. z", "one REF two", "\nleading. newline", "", "   ", "plain",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


N_TOKENS = r"len(regexp_extract_all(text, '[^ \t\n\r]+'))"
SQL_BUCKET = "CASE WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 512 THEN 512 WHEN n <= 1024 THEN 1024 ELSE 2048 END"
SQL_TOKENS = f"tok AS (SELECT doc_id, {N_TOKENS} AS n FROM documents WHERE {N_TOKENS} > 0), buck AS (SELECT doc_id, n, {SQL_BUCKET} AS bucket, greatest(n - 2048, 0) AS truncated FROM tok)"
SQL_PROMPT = "'Answer the question as briefly as possible, based only on the context:' || chr(10) || ' Context:' || {c} || chr(10) || ' Question:' || {q} || chr(10) || ' Answer:'"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, truncated) of all documents that have words."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", text_functions.token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    bucket, cut = buckets.assign_bucket(F.col("n_tokens"))
    return d.select("doc_id", "n_tokens", bucket.alias("bucket"), cut.alias("truncated"))


@query("bucket_counts", f"WITH {SQL_TOKENS} SELECT bucket, count(*) AS records, sum(truncated) AS truncated_tokens FROM buck GROUP BY bucket")
def bucket_counts(spark, sf_dir):
    return token_rows(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("records"), F.sum("truncated").alias("truncated_tokens"))


@query("bucket_assign", f"WITH {SQL_TOKENS} SELECT doc_id, n AS n_tokens, bucket, truncated FROM buck")
def bucket_assign(spark, sf_dir):
    return token_rows(spark, sf_dir)


@query("input_digest", "SELECT doc_id AS source_index, text, sha256(text) AS input_sha256 FROM documents")
def input_digest(spark, sf_dir):
    return records.with_digest(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"), "text"))


@query("record_prejoined", "SELECT d.doc_id AS source_index, d.text, '' AS question, '' AS answer, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def record_prejoined(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias("source_index"), F.to_json(F.struct("text", "label")).alias("value"))
    return records.normalize_records(rows).select("source_index", "text", "question", "answer", "label")


def structured(spark, sf_dir, view: str) -> DataFrame:
    pairs = records.conversation_pairs(read_table(spark, sf_dir, "conversations"))
    rows = pairs.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("source_index"), F.to_json(F.struct("context", "question", "best_answer")).alias("value"))
    return records.normalize_records(rows, view=view, strict=False).where("NOT rejected").select("source_index", "text", "question", "answer", "context", "original_answer")


SQL_PAIRS = """pairs AS (
  SELECT u.conv_id * 100000 + u.turn AS source_index, u.text AS question, a.text AS original_answer, coalesce(s.text, '') AS context
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user'
  LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.role = 'system' AND s.turn = 0)"""
SQL_KEPT = f"{sql_strip('question')} <> '' AND {sql_strip('answer')} <> ''"
SQL_RECORD = f"SELECT source_index, {SQL_PROMPT.format(c=sql_strip('context'), q=sql_strip('question'))} || ' ' || answer AS text, question, answer, context, original_answer FROM r WHERE {SQL_KEPT}"


@query("record_structured_full", f"WITH {SQL_PAIRS}, r AS (SELECT *, original_answer AS answer FROM pairs) {SQL_RECORD}")
def record_structured_full(spark, sf_dir):
    return structured(spark, sf_dir, "full")


SQL_MARKERS = "(?s)(?:\\n|Q:|A:|question:|answer:|Question:|Answer:|Questions:|questions:|QUESTION:|ANSWER:|REF|\\.Forms|http|php|Question|Answer).*"


def sql_cut(x: str) -> str:
    return f"coalesce(nullif({sql_strip(f'regexp_replace({x}, {chr(39)}{SQL_MARKERS}{chr(39)}, {chr(39)}{chr(39)})')}, ''), {sql_strip(x)})"


# Walks from mark to mark: p is the first character not yet judged, m the mark at or behind it (0: none), stop whether it ends the sentence.
SQL_SENTENCE = r"""
walk(id, s, p, m, stop) AS (
  SELECT id, s, 1, 0, false FROM src
  UNION ALL
  SELECT id, s, CASE WHEN m2 = 0 THEN length(s) + 2 WHEN dots THEN m2 + 3 ELSE m2 + 1 END, m2, m2 > 0 AND NOT dots AND NOT skip
  FROM (
    SELECT *, CASE
      WHEN c = '.' AND regexp_matches(lc, '^\p{Nd}$') AND regexp_matches(rc, '^\p{Nd}') THEN true
      WHEN c = '.' AND regexp_matches(lc, '^\p{L}$') AND regexp_matches(rc, '^\p{L}\.') THEN true
      WHEN contains(token, '.') AND regexp_matches(token || '.', '^(?:[A-Za-z]\.){2,}$') THEN true
      WHEN token IN ('Mr','Mrs','Ms','Dr','Prof','Sr','Jr','Gen','Brig','Adm','Rear','Lt','Col','Maj','Capt','St','vs','etc','Fig','Eq') THEN true
      WHEN token = 'No' THEN regexp_matches(rest, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{3000}]*\p{Nd}')
      WHEN regexp_matches(token, '^[A-Za-z]$') THEN regexp_matches(rest, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{3000}]*\p{Lu}')
      ELSE false END AS skip
    FROM (
      SELECT id, s, m2, substr(s, m2, 1) AS c, substr(s, m2, 3) = '...' AS dots, CASE WHEN m2 > 1 THEN substr(s, m2 - 1, 1) ELSE '' END AS lc, substr(s, m2 + 1, 2) AS rc,
        regexp_extract(substr(s, 1, m2 - 1), '[\p{L}.]*$') AS token, substr(s, m2 + 1) AS rest
      FROM (
        SELECT id, s, CASE WHEN p > length(s) OR NOT regexp_matches(substr(s, p), '[.!?]') THEN 0 ELSE p + length(regexp_extract(substr(s, p), '^[^.!?]*')) END AS m2
        FROM walk WHERE NOT stop AND p <= length(s) + 1))))
"""
SQL_SENTENCE_OF = f"SELECT id, CASE WHEN stop THEN {sql_strip('substr(s, 1, m)')} ELSE s END AS sentence FROM walk WHERE stop OR p = length(s) + 2"


@query("record_structured_fst", f"WITH RECURSIVE {SQL_PAIRS}, src AS (SELECT source_index AS id, {sql_cut('original_answer')} AS s FROM pairs), {SQL_SENTENCE}, r AS (SELECT pairs.*, sentence AS answer FROM pairs JOIN ({SQL_SENTENCE_OF}) w ON w.id = source_index) {SQL_RECORD}")
def record_structured_fst(spark, sf_dir):
    return structured(spark, sf_dir, "first_sentence")


@query("summary_prompt_text", f"SELECT doc_id, 'Summarize the following document in one or two concise sentences.' || chr(10) || 'Document:' || {sql_strip('text')} || chr(10) || 'Summary:' AS prompt FROM documents")
def summary_prompt_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text_functions.summary_prompt(F.col("text")).alias("prompt"))


def _literal_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(LITERALS)], "doc_id long, text string")


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_TEXTS = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {_sql_text(t)})" for i, t in enumerate(LITERALS)) + ") v(doc_id, text))"


def all_texts(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_literal_rows(spark))


@query("marker_cut", f"WITH {SQL_TEXTS} SELECT doc_id, {sql_cut('text')} AS cut FROM texts")
def marker_cut(spark, sf_dir):
    return all_texts(spark, sf_dir).select("doc_id", text_functions.marker_cut(F.col("text")).alias("cut"))


@query("first_sentence", f"WITH RECURSIVE {SQL_TEXTS}, src AS (SELECT doc_id AS id, {sql_strip('text')} AS s FROM texts), {SQL_SENTENCE} SELECT id AS doc_id, sentence FROM ({SQL_SENTENCE_OF})")
def first_sentence(spark, sf_dir):
    return all_texts(spark, sf_dir).select("doc_id", text_functions.first_sentence(F.col("text")).alias("sentence"))


@query("text_strip", f"WITH {SQL_TEXTS} SELECT doc_id, {sql_strip('text')} AS stripped FROM texts")
def text_strip(spark, sf_dir):
    return all_texts(spark, sf_dir).select("doc_id", text_functions.strip(F.col("text")).alias("stripped"))


SQL_ORDINAL = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents"


def ordinals(spark, sf_dir) -> DataFrame:
    return packing.with_ordinal(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("line_window", f"SELECT * FROM ({SQL_ORDINAL}) WHERE ordinal >= 100 AND ordinal < 600")
def line_window(spark, sf_dir):
    return ordinals(spark, sf_dir).where(packing.in_window(F.col("ordinal"), 100, 500))


@query("positional_sample", f"SELECT * FROM ({SQL_ORDINAL}) WHERE ordinal IN (7, 11, 16, 22, 25, 29, 84, 88)")
def positional_sample(spark, sf_dir):
    from ..sources.jsonl import SAMPLE_POSITIONS

    return ordinals(spark, sf_dir).where(F.col("ordinal").isin(*SAMPLE_POSITIONS))


@query("strided_partition", f"SELECT doc_id, ordinal, CAST(ordinal % {WRITERS} AS INTEGER) AS rank FROM ({SQL_ORDINAL})")
def strided_partition(spark, sf_dir):
    return ordinals(spark, sf_dir).withColumn("rank", packing.rank_of(F.col("ordinal"), WRITERS))


SQL_BATCHES = f"{SQL_TOKENS}, b AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS bucket_ordinal, count(*) OVER (PARTITION BY bucket) AS size FROM buck), bb AS (SELECT *, bucket_ordinal // {BATCH} AS batch_id FROM b)"


@query("batch_plan", f"WITH {SQL_BATCHES} SELECT doc_id, bucket, bucket_ordinal, batch_id, CASE WHEN batch_id = (size - 1) // {BATCH} THEN ({BATCH} - size % {BATCH}) % {BATCH} ELSE 0 END AS batch_pad FROM bb")
def batch_plan(spark, sf_dir):
    return packing.with_batches(token_rows(spark, sf_dir).select("doc_id", "bucket"), BATCH, "doc_id").select("doc_id", "bucket", "bucket_ordinal", "batch_id", "batch_pad")


def shard_rows(spark, sf_dir) -> DataFrame:
    return packing.with_shards(token_rows(spark, sf_dir).select("doc_id", "bucket"), BATCH, SHARD, "doc_id").select("doc_id", "bucket", "batch_id", "shard", "offset")


SQL_SHARDS = f"""{SQL_BATCHES},
per AS (SELECT bucket, batch_id, count(*) AS n, row_number() OVER (ORDER BY bucket, batch_id) AS i FROM bb GROUP BY bucket, batch_id),
fold(i, shard, before, after) AS (
  SELECT 1::BIGINT, 0::BIGINT, 0::BIGINT, (SELECT n FROM per WHERE i = 1)
  UNION ALL
  SELECT p.i, f.shard + CASE WHEN f.after >= {SHARD} THEN 1 ELSE 0 END, CASE WHEN f.after >= {SHARD} THEN 0 ELSE f.after END, CASE WHEN f.after >= {SHARD} THEN 0 ELSE f.after END + p.n
  FROM fold f JOIN per p ON p.i = f.i + 1),
plan AS (SELECT bb.doc_id, bb.bucket, bb.batch_id, fold.shard, fold.before + bb.bucket_ordinal - bb.batch_id * {BATCH} AS "offset" FROM bb JOIN per USING (bucket, batch_id) JOIN fold USING (i))"""


@query("shard_plan", f"WITH RECURSIVE {SQL_SHARDS} SELECT * FROM plan")
def shard_plan(spark, sf_dir):
    return shard_rows(spark, sf_dir)


@query("manifest_rollup", f"WITH RECURSIVE {SQL_SHARDS} SELECT count(*) AS records, count(DISTINCT shard) AS num_shards, coalesce(max(shard), -1) + 1 AS next_shard FROM plan")
def manifest_rollup(spark, sf_dir):
    return integrity.manifest_rollup(shard_rows(spark, sf_dir))


@query("shard_offsets", f'WITH RECURSIVE {SQL_SHARDS} SELECT shard, count(*) AS rows, count(DISTINCT "offset") = count(*) AND min("offset") = 0 AND max("offset") = count(*) - 1 AS contiguous FROM plan GROUP BY shard')
def shard_offsets(spark, sf_dir):
    return integrity.shard_offsets(shard_rows(spark, sf_dir))


@query("records_per_rank", f"WITH {SQL_TOKENS}, o AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) % {WRITERS} AS rank FROM buck) SELECT CAST(rank AS INTEGER) AS rank, bucket, count(*) AS records FROM o GROUP BY ALL")
def records_per_rank(spark, sf_dir):
    rows = packing.with_ordinal(token_rows(spark, sf_dir), "doc_id")
    return rows.withColumn("rank", packing.rank_of(F.col("ordinal"), WRITERS)).groupBy("rank", "bucket").agg(F.count("*").alias("records"))


@query("resume_remaining", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    return integrity.remaining(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), "doc_id")


SQL_SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END"


def split_labels(spark, sf_dir) -> DataFrame:
    own = read_table(spark, sf_dir, "labels").withColumn("paper_split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return own.select("doc_id", "paper_split", F.col("quality").alias("label"), "toxic")


@query("union_parts", f"SELECT doc_id, {SQL_SPLIT} AS paper_split, quality AS label, toxic FROM labels")
def union_parts(spark, sf_dir):
    own = split_labels(spark, sf_dir)
    return integrity.union_parts([own.where("toxic = 0"), own.where("toxic <> 0")])


@query("split_counts", f"SELECT {SQL_SPLIT} AS paper_split, count(*) AS n FROM labels GROUP BY 1")
def split_counts(spark, sf_dir):
    return split_labels(spark, sf_dir).groupBy("paper_split").agg(F.count("*").alias("n"))


@query("count_mismatches", f"WITH o AS (SELECT {SQL_SPLIT} AS paper_split, count(*) AS observed FROM labels GROUP BY 1), e AS (SELECT * FROM (VALUES ('train', 8000), ('test', 2000), ('dev', 0)) v(paper_split, expected)) SELECT paper_split, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed FROM o FULL JOIN e USING (paper_split) WHERE coalesce(expected, 0) <> coalesce(observed, 0)")
def count_mismatches(spark, sf_dir):
    return integrity.count_mismatches(split_labels(spark, sf_dir), {("train",): 8000, ("test",): 2000, ("dev",): 0}, ["paper_split"])


@query("label_balance", f"WITH s AS (SELECT {SQL_SPLIT} AS paper_split, quality AS label FROM labels) SELECT paper_split, label, count(*) AS n, (SELECT count(DISTINCT t.label) = 2 FROM s t WHERE t.paper_split = s.paper_split AND t.label IN (0, 1)) AS both_classes FROM s GROUP BY paper_split, label")
def label_balance(spark, sf_dir):
    return integrity.label_histogram(split_labels(spark, sf_dir), ["paper_split"])


@query("cross_view_mismatch", f"WITH RECURSIVE {SQL_PAIRS}, src AS (SELECT source_index AS id, {sql_cut('original_answer')} AS s FROM pairs), {SQL_SENTENCE} SELECT source_index, 'answer' AS \"column\" FROM pairs JOIN ({SQL_SENTENCE_OF}) w ON id = source_index WHERE {sql_strip('question')} <> '' AND sentence <> '' AND sentence <> original_answer")
def cross_view_mismatch(spark, sf_dir):
    full, cut = (structured(spark, sf_dir, v) for v in config.VIEWS)
    return integrity.cross_view_mismatches(full, cut, ["context", "question", "answer"])


@query("index_coverage", "WITH s AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT unnest(range(0, 20000)) AS doc_id) SELECT coalesce(r.doc_id, s.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'unexpected' ELSE 'missing' END AS problem FROM r FULL JOIN s ON r.doc_id = s.doc_id WHERE r.doc_id IS NULL OR s.doc_id IS NULL")
def index_coverage(spark, sf_dir):
    return integrity.coverage_gaps(read_table(spark, sf_dir, "labels"), 0, 20_000, "doc_id")


@query("duplicate_texts", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return integrity.duplicates(read_table(spark, sf_dir, "documents"), "text")


# Rows that break one rule each, beside the fixture's.
BAD_ROWS = ((-1, None, 0), (-2, "", 1), (-3, "train", 2), (-4, "dev", 0), (-5, "train", None))


@query("required_fields", f"""WITH rows AS (SELECT doc_id AS source_index, {SQL_SPLIT} AS paper_split, quality AS label FROM labels
UNION ALL SELECT * FROM (VALUES (-1, NULL, 0), (-2, '', 1), (-3, 'train', 2), (-4, 'dev', 0), (-5, 'train', NULL)) v)
SELECT source_index, 'missing ' || concat_ws(',', CASE WHEN label IS NULL THEN 'label' END, CASE WHEN coalesce(paper_split, '') = '' THEN 'paper_split' END) AS problem FROM rows WHERE label IS NULL OR coalesce(paper_split, '') = ''
UNION ALL SELECT source_index, 'invalid paper_split' FROM rows WHERE paper_split NOT IN ('train', 'test')
UNION ALL SELECT source_index, 'invalid label' FROM rows WHERE label NOT IN (0, 1)""")
def required_fields(spark, sf_dir):
    own = split_labels(spark, sf_dir).select(F.col("doc_id").alias("source_index"), "paper_split", "label")
    bad = spark.createDataFrame(list(BAD_ROWS), "source_index long, paper_split string, label int")
    return integrity.row_problems(own.unionByName(bad), ("paper_split", "label"), splits=("train", "test"))


@query("artifact_violations", f"""WITH RECURSIVE {SQL_SHARDS},
meta AS (SELECT doc_id AS source_index, 0 AS rank, shard, "offset" FROM plan UNION ALL SELECT * FROM (VALUES (0, 0, 0, 9000), (-1, 0, 100000, 0), (-2, 7, 0, 9001)) v),
tensors AS (SELECT shard, count(*) AS rows FROM plan GROUP BY shard),
stats AS (SELECT shard, count(*) AS rows, count(DISTINCT "offset") = count(*) AND min("offset") = 0 AND max("offset") = count(*) - 1 AS ok FROM meta GROUP BY shard),
totals AS (SELECT (SELECT count(*) FROM meta) AS m, (SELECT sum(rows) FROM tensors) AS t)
SELECT 'missing_metadata' AS rule, '1' AS subject, 'no rows of this rank' AS detail
UNION ALL SELECT 'foreign_rank', CAST(rank AS VARCHAR), CAST(count(*) AS VARCHAR) FROM meta WHERE rank < 0 OR rank >= 2 GROUP BY rank
UNION ALL SELECT 'missing_shard', CAST(shard AS VARCHAR), 'metadata refers to it' FROM stats WHERE shard NOT IN (SELECT shard FROM tensors)
UNION ALL SELECT 'offsets', CAST(s.shard AS VARCHAR), 'incomplete or duplicate' FROM stats s JOIN tensors t ON t.shard = s.shard WHERE NOT ok OR s.rows <> t.rows
UNION ALL SELECT 'duplicate_index', CAST(source_index AS VARCHAR), CAST(count(*) AS VARCHAR) FROM meta GROUP BY source_index HAVING count(*) > 1
UNION ALL SELECT 'metadata_rows', '5', CAST(m AS VARCHAR) FROM totals WHERE m <> 5
UNION ALL SELECT 'tensor_rows', '5', CAST(t AS VARCHAR) FROM totals WHERE t <> 5
UNION ALL SELECT 'manifest_tensor_rows', '6', CAST(t AS VARCHAR) FROM totals WHERE t <> 6""")
def artifact_violations(spark, sf_dir):
    plan = shard_rows(spark, sf_dir)
    bad = spark.createDataFrame([(0, 0, 0, 9000), (-1, 0, 100_000, 0), (-2, 7, 0, 9001)], "source_index long, rank int, shard long, offset long")
    meta = plan.select(F.col("doc_id").alias("source_index"), F.lit(0).alias("rank"), "shard", "offset").unionByName(bad)
    return integrity.metadata_problems(meta, plan.groupBy("shard").agg(F.count("*").alias("rows")), 2, 5, 6)


@query("same_rows", "(SELECT doc_id, quality AS label, 'left' AS side FROM labels EXCEPT ALL SELECT doc_id, toxic, 'left' FROM labels) UNION ALL (SELECT doc_id, toxic, 'right' FROM labels EXCEPT ALL SELECT doc_id, quality, 'right' FROM labels)")
def same_rows(spark, sf_dir):
    own = read_table(spark, sf_dir, "labels")
    return integrity.same_rows(own.select("doc_id", F.col("quality").alias("label")), own.select("doc_id", F.col("toxic").alias("label")))


@query("rms_norm", "SELECT vec_id, round(CAST(embedding[len(embedding)] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding) + 1e-5), 9) AS last_normed FROM embeddings")
def rms_norm(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(tensors.rms_norm(F.col("embedding")), -1), 9).alias("last_normed"))


@query("finite_check", "SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM embeddings UNION ALL SELECT * FROM (VALUES (-1, false), (-2, false), (-3, true)) v")
def finite_check(spark, sf_dir):
    bad = spark.createDataFrame([(-1, [1.0, float("nan")]), (-2, [float("-inf")]), (-3, [0.5])], "vec_id long, embedding array<float>")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(bad).select("vec_id", tensors.is_finite(F.col("embedding")).alias("finite"))


@query("tensor_shape", "SELECT vec_id, len(embedding) = 64 AS fits, len(embedding) AS width FROM embeddings")
def tensor_shape(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", tensors.has_shape(F.col("embedding"), (64,)).alias("fits"), F.size("embedding").alias("width"))


@query("last_layer_slice", "SELECT vec_id, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last_value, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, 2 AS layers FROM embeddings")
def last_layer_slice(spark, sf_dir):
    v = F.col("embedding")
    stacked = tensors.stack_layers(v, F.array(v, F.reverse(v)))
    own, states = tensors.split_layers(stacked)
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(tensors.last_position(own).cast("double"), 6).alias("last_value"), F.round(tensors.last_position(tensors.last_position(states)).cast("double"), 6).alias("first_value"), F.size(states).alias("layers"))


@query("left_pad_truncate", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 256 THEN w[len(w) - 255] ELSE '<pad>' END AS first_token, w[len(w)] AS last_token, greatest(256 - len(w), 0) AS n_pad, least(len(w), 256) AS n_real FROM t WHERE len(w) > 0""")
def left_pad_truncate(spark, sf_dir):
    words = text_functions.tokens(F.col("text"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    padded, mask = buckets.pad_left(F.col("w"), 256, F.lit("<pad>")), buckets.attention_mask(F.col("w"), 256)
    d = d.select("doc_id", padded.alias("p"), mask.alias("m"))
    return d.select("doc_id", F.get("p", F.lit(0)).alias("first_token"), F.element_at("p", -1).alias("last_token"), F.size(F.filter("m", lambda x: x == 0)).alias("n_pad"), F.size(F.filter("m", lambda x: x == 1)).alias("n_real"))


SQL_CONTENT = """l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, text FROM documents), h AS (SELECT sha256(CAST(line AS VARCHAR) || ':' || text) AS d FROM l),
c AS (SELECT count(*) AS lines, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * k}, 15) AS BIGINT)) AS HUGEINT) AS s{k}" for k in range(4)) + """ FROM h),
content AS (SELECT lines, sha256(concat_ws(':', lines, s0, s1, s2, s3)) AS digest FROM c)"""


def content(spark, sf_dir) -> DataFrame:
    from ..sources.digests import content_digest

    return content_digest(packing.with_ordinal(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", name="line", computed=False), value="text")


@query("content_digest", f"WITH {SQL_CONTENT} SELECT * FROM content")
def content_digest(spark, sf_dir):
    return content(spark, sf_dir)


@query("config_hash", f"""WITH {SQL_CONTENT} SELECT sha256('{{"batch_size":{BATCH},"input_content":{{"digest":"' || digest || '","lines":' || lines || '}},"shard_size":{SHARD}}}') AS config_sha256 FROM content""")
def config_hash(spark, sf_dir):
    from ..sources.jsonl import json_digest

    own = json_digest({"shard_size": SHARD, "batch_size": BATCH, "input_content": content(spark, sf_dir).first().asDict()})
    return spark.createDataFrame([(own,)], "config_sha256 string")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written_lines(spark: SparkSession, sf_dir: str, worded: bool = False) -> str:
    """Documents as compressed JSON lines, by doc_id; with worded, a blank line, which uses up its number, stands for one without words."""
    from ..sources.jsonl import write_lines

    path = _folder(spark, "lines")
    value = F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})
    if worded:
        value = F.when(text_functions.token_count(F.col("text")) > 0, value).otherwise("")
    write_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").select(value.alias("value")), path)
    return path


@query("jsonl_scan", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS source_index, sha256(text) AS input_sha256 FROM documents")
def jsonl_scan(spark, sf_dir):
    from ..sources.jsonl import load_rows

    rows = load_rows(spark, _written_lines(spark, sf_dir))
    return records.normalize_records(rows).select("source_index", F.sha2("text", 256).alias("input_sha256"))


@query("artifact_roundtrip", f"WITH RECURSIVE {SQL_SHARDS} SELECT count(*) AS records, count(DISTINCT shard) AS num_shards, count(*) AS validated, true AS valid FROM plan")
def artifact_roundtrip(spark, sf_dir):
    own = config.RunConfig(input=_written_lines(spark, sf_dir, worded=True), output=_folder(spark, "artifact"), width=16, shard_size=SHARD)
    manifest = jobs.extract(spark, own)
    report = jobs.validate(spark, own)
    return spark.createDataFrame([(manifest["records"], manifest["num_shards"], report["records"], report["valid"])], "records long, num_shards long, validated long, valid boolean")


SQL_SUMMARY = "'Summarize the following document in one or two concise sentences.' || chr(10) || 'Document:' || source || chr(10) || 'Summary:'"


@query("prompt_mismatch", f"""WITH rows AS (SELECT doc_id, {SQL_SUMMARY} || ' ' || lang AS wanted, {SQL_SUMMARY} || CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' ' END || lang || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END AS text FROM documents)
SELECT doc_id AS source_index FROM rows WHERE text IS DISTINCT FROM wanted""")
def prompt_mismatch(spark, sf_dir):
    gap = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(" ")
    end = F.when(F.col("doc_id") % 11 == 0, "!").otherwise("")
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("context"), F.concat(F.lit(" "), "lang", F.lit("\t")).alias("best_answer"), F.col("lang"))
    d = d.select(F.col("doc_id").alias("source_index"), "context", "best_answer", F.concat(text_functions.summary_prompt(F.col("context")), gap, "lang", end).alias("text"))
    return integrity.prompt_mismatches(d)


@query("hidden_shape", "SELECT vec_id, len(embedding[1:32]) = 32 AND len(embedding[33:CASE WHEN vec_id % 5 = 0 THEN 63 ELSE 64 END]) = 32 AS fits FROM embeddings")
def hidden_shape(spark, sf_dir):
    second = F.slice("embedding", F.lit(33), F.when(F.col("vec_id") % 5 == 0, 31).otherwise(32))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", tensors.has_shape(F.array(F.slice("embedding", 1, 32), second), (2, 32)).alias("fits"))


@query("layers_complete", "SELECT vec_id, len(list_filter(embedding[1:4], lambda x: x > -1)) = 4 AS complete FROM embeddings")
def layers_complete(spark, sf_dir):
    held = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at("embedding", k + 1) > -1)  # the layers that a record has, by its data
    by_layer = F.map_from_arrays(held, F.transform(held, lambda k: F.slice("embedding", k * 16 + 1, F.lit(16))))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", tensors.complete_layers(by_layer, 4).alias("complete"))


@query("bucket_histogram", f"WITH {SQL_TOKENS}, n AS (SELECT bucket, count(*) AS n FROM buck GROUP BY bucket) SELECT string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS bucket_counts FROM n")
def bucket_histogram(spark, sf_dir):
    entries = F.transform(F.map_entries("bucket_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return integrity.histogram_map(token_rows(spark, sf_dir), "bucket").select(F.array_join(entries, ",").alias("bucket_counts"))


@query("shard_names", f"WITH RECURSIVE {SQL_SHARDS}, n AS (SELECT DISTINCT shard FROM plan) SELECT printf('rank-%03d/shard-%05d', shard % {WRITERS}, shard) AS name, shard AS number FROM n")
def shard_names(spark, sf_dir):
    shards = shard_rows(spark, sf_dir).select("shard").distinct()
    name = packing.shard_name(F.col("shard"), F.pmod("shard", F.lit(WRITERS)).cast("int"))
    return shards.select(name.alias("name"), packing.shard_number(name).alias("number"))


@query("view_domain", "SELECT doc_id AS source_index, 'answer_view mismatch' AS problem FROM documents WHERE lang IS NULL OR lang <> 'en'")
def view_domain(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"), F.lit(1).alias("label"), F.coalesce("lang", F.lit("none")).alias("answer_view"))
    return integrity.row_problems(d, ("source_index", "label"), view="en")


#: The CRC-32 of a hex string h's bytes, with its table t.
SQL_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"
SQL_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
LAYERS, WIDTH = 4, 8
SQL_LAYERS = ", ".join(f"CAST(sum(CASE WHEN back <= {k} THEN v END) AS DOUBLE) AS layer_{k}" for k in range(LAYERS))


@query("layer_states", rf"""WITH {SQL_CRC_TABLE},
l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS source_index, regexp_extract_all(text, '[^ 	

]+') AS w FROM documents),
b AS (SELECT source_index, w, unnest(range(0, least(len(w), {LAYERS}))) AS back FROM l),
i AS (SELECT source_index, back, {SQL_CRC} % 50000 AS id FROM (SELECT source_index, back, hex(encode(w[len(w) - back])) AS h FROM b), crc),
e AS (SELECT source_index, back, list_sum(list_transform(range(0, {WIDTH}), lambda j: (j + 1) * ((31 * id + 17 * j) % 97 - 48))) / 64 AS v FROM i)
SELECT source_index, CAST(max(CASE WHEN back = 0 THEN v END) AS DOUBLE) AS embedding, {SQL_LAYERS} FROM e GROUP BY source_index""")
def layer_states(spark, sf_dir):
    """All documents that have words through the job, four layers each, read back from the artifact; a vector is shown as the sum of its places, each times its number."""
    from ..sources import artifact

    own = config.RunConfig(input=_written_lines(spark, sf_dir, worded=True), output=_folder(spark, "layers"), width=WIDTH, layers=LAYERS, shard_size=SHARD, batch_size=BATCH, world_size=1)
    jobs.extract(spark, own)
    shown = lambda v: F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.lit(WIDTH)), lambda x, j: x.cast("double") * j), F.lit(0.0), lambda a, x: a + x)
    df = artifact.read_shards(spark, own.output)
    return df.select("source_index", shown(F.col("embedding")).alias("embedding"), *(shown(F.col("hidden_states")[k]).alias(f"layer_{k}") for k in range(LAYERS)))


SQL_BFLOAT = "CASE WHEN x = 0 THEN 0 ELSE round_even(CAST(x AS DOUBLE) / pow(2, floor(log2(abs(CAST(x AS DOUBLE)))) - 7), 0) * pow(2, floor(log2(abs(CAST(x AS DOUBLE)))) - 7) END"


@query("bfloat16_pack", f"SELECT vec_id, list_reduce(list_transform(embedding, lambda x: {SQL_BFLOAT}), lambda a, x: a + x) AS total, 2 * len(embedding) AS n_bytes, true AS finite FROM embeddings UNION ALL SELECT * FROM (VALUES (-1, NULL, 4, false), (-2, NULL, 2, false)) v")
def bfloat16_pack(spark, sf_dir):
    bad = spark.createDataFrame([(-1, [1.0, float("nan")]), (-2, [float("-inf")])], "vec_id long, embedding array<float>")
    packed = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(bad).select("vec_id", tensors.pack_bfloat16("embedding").alias("p"))
    floats = F.transform(tensors.unpack_bfloat16("p"), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(F.col("v"), 2, F.greatest(F.size("v") - 1, F.lit(0))), F.col("v")[0], lambda a, x: a + x)
    rows = packed.select("vec_id", floats.alias("v"), F.octet_length("p").cast("long").alias("n_bytes"), tensors.packed_finite("p").alias("finite"))
    return rows.select("vec_id", F.when(F.col("finite"), total).alias("total"), "n_bytes", "finite")


# Merges of a small vocabulary, in the order of their ranks.
MERGES = ("th", "in", "er", "an", "on", "re", "he", "the", "ing", "and", "st", "en", "her", "ti", "tion")
SQL_HEX = ["".join(f"{b:02X}" for b in m.encode()) for m in MERGES]


def sql_merged(x: str) -> str:
    """Tokens in brackets: each merge in the order of ranks joins all its pairs."""
    hexed = lambda t: "".join(f"{b:02X}" for b in t.encode())
    for k in range(len(MERGES)):
        for i in range(1, len(MERGES[k])):
            a, b = MERGES[k][:i], MERGES[k][i:]
            if a in {*MERGES[:k], *MERGES[k]} and b in {*MERGES[:k], *MERGES[k]}:
                x = f"replace({x}, '[{hexed(a)}][{hexed(b)}]', '[{hexed(a + b)}]')"
    return x


@query("merge_rank_tokens", f"""WITH b AS (SELECT doc_id, regexp_replace(upper(hex(encode(text))), '(..)', '[\\1]', 'g') AS x FROM documents),
m AS (SELECT doc_id, {sql_merged('x')} AS x FROM b),
t AS (SELECT doc_id, list_transform(list_filter(string_split(replace(x, '[', ''), ']'), lambda t: t <> ''), lambda t: CASE WHEN len(t) = 2 THEN CAST('0x' || t AS INTEGER) ELSE 255 + list_position({SQL_HEX}, t) END) AS ids FROM m)
SELECT doc_id, len(ids) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5, array_to_string(ids[greatest(1, len(ids) - 7):], ',') AS last_ids, greatest(0, 8 - len(ids)) AS n_pad FROM t""")
def merge_rank_tokens(spark, sf_dir):
    from ..functions.tokenizer import merge_ids

    ranks = {bytes([b]): b for b in range(256)} | {m.encode(): 256 + k for k, m in enumerate(MERGES)}
    d = read_table(spark, sf_dir, "documents").select("doc_id", merge_ids(spark, ranks)(F.col("text")).alias("ids"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    padded, mask = buckets.pad_left(F.col("ids"), 8, F.lit(-1)), buckets.attention_mask(F.col("ids"), 8)
    real = F.filter(padded, lambda x: x >= 0)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(joined(F.col("ids")).cast("binary")).alias("ids_md5"), joined(real).alias("last_ids"), F.size(F.filter(mask, lambda x: x == 0)).cast("long").alias("n_pad"))


@query("record_rejects", f"WITH {SQL_PAIRS}, r AS (SELECT *, original_answer AS answer FROM pairs) SELECT source_index FROM r WHERE NOT ({SQL_KEPT}) UNION ALL SELECT -1 - conv_id * 100000 - turn FROM conversations WHERE role = 'system'")
def record_rejects(spark, sf_dir):
    """Pairs without a question or an answer, and system turns, which have a question alone."""
    c = read_table(spark, sf_dir, "conversations")
    pairs = records.conversation_pairs(c).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("source_index"), F.to_json(F.struct("context", "question", "best_answer")).alias("value"))
    lone = c.where("role = 'system'").select((-1 - F.col("conv_id") * 100_000 - F.col("turn")).alias("source_index"), F.to_json(F.struct(F.col("text").alias("question"))).alias("value"))
    return records.normalize_records(pairs.unionByName(lone), strict=False).where("rejected").select("source_index")


@query("presence_chain", """SELECT doc_id AS source_index, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN 'story of ' || source ELSE '' END AS context, CASE WHEN lang = 'en' THEN 'first' WHEN lang = 'de' THEN lang ELSE source END AS original_answer FROM documents""")
def presence_chain(spark, sf_dir):
    """Fields by the first key that is there: context before story, the best answer before the answer, which may be nested."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    english = F.to_json(F.struct(F.lit("q").alias("question"), F.col("source").alias("context"), F.lit("story").alias("story"), F.lit("first").alias("best_answer"), F.lit("second").alias("answer")))
    german = F.to_json(F.struct(F.lit("q").alias("question"), F.concat(F.lit("story of "), "source").alias("story"), F.struct(F.col("lang").alias("text")).alias("answer")))
    other = F.to_json(F.struct(F.lit("q").alias("question"), F.array("source", F.lit("later")).alias("answers")))
    value = F.when(F.col("lang") == "en", english).when(F.col("lang") == "de", german).otherwise(other)
    return records.normalize_records(d.select(F.col("doc_id").alias("source_index"), value.alias("value"))).select("source_index", "context", "original_answer")


@query("bucket_order", f"WITH {SQL_TOKENS}, b AS (SELECT DISTINCT n % 50 + 1 AS b FROM buck) SELECT string_agg(b, ',' ORDER BY b) AS buckets FROM b")
def bucket_order(spark, sf_dir):
    """Lengths in any order and repeated become buckets that ascend."""
    found = [r[0] for r in token_rows(spark, sf_dir).select((F.col("n_tokens") % 50 + 1).alias("b")).distinct().collect()]  # 50 at most
    return spark.createDataFrame([(",".join(map(str, buckets.normalized_buckets(found[::-1] + found))),)], "buckets string")


SQL_DAMAGE = "(SELECT count(*) FROM plan WHERE shard = 1)"


@query("artifact_problems", f"""WITH RECURSIVE {SQL_SHARDS}, n AS (SELECT count(*) AS n, count(DISTINCT shard) AS shards FROM plan)
SELECT 'whole' AS artifact, n AS records, shards, true AS valid, '' AS rules FROM n
UNION ALL SELECT 'damaged', n - {SQL_DAMAGE}, shards - 1, false, 'damaged_file,duplicate_index,manifest_tensor_rows,metadata_rows,missing_rows,missing_shard,tensor_rows,vector_columns' FROM n""")
def artifact_problems(spark, sf_dir):
    """An artifact as it was written, and a copy that lost a shard, holds rows of a shard that the index hasn't, and a file of other columns."""
    from ..sources import artifact
    from ..sources.jsonl import read_document

    own = config.RunConfig(input=_written_lines(spark, sf_dir, worded=True), output=_folder(spark, "whole"), width=WIDTH, shard_size=SHARD, layers=2, dtype="bfloat16")
    jobs.extract(spark, own)
    other = f"{own.output}-damaged"
    df = artifact.read_shards(spark, own.output)
    stray = df.where("shard = 0 AND offset = 0").withColumn("shard", F.lit(1_000_000).cast("long"))
    df.where("shard <> 1").unionByName(stray).write.parquet(f"{other}/states")
    df.where("shard = 2").drop("hidden_states").write.mode("append").parquet(f"{other}/states")
    for name in ("index", "files"):
        spark.read.parquet(f"{own.output}/{name}").write.parquet(f"{other}/{name}")
    from ..sources.jsonl import write_document

    write_document(spark, f"{other}/manifest.json", read_document(spark, f"{own.output}/manifest.json"))
    rows = []
    for name, folder in (("whole", own.output), ("damaged", other)):
        r = artifact.validate_artifact(spark, folder, WIDTH, 2, dtype="bfloat16")
        rows.append((name, r["records"], r["shards"], r["valid"], ",".join(sorted(p.split()[0] for p in r["problems"]))))
    return spark.createDataFrame(rows, "artifact string, records long, shards long, valid boolean, rules string")
