"""The numbered operators' queries over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import alignment, codebooks, decontaminate, language_model, lines, mixing, neighbours, quality, sharding, simhash, tokens, toxicity, warc
from sieveline.llm.labels import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), width=3, max_bits=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.section_tokens(table(spark, sf_dir, "documents"), fields=("text",), separator="\n", rule="first")
    return counted.select("doc_id", "section", "char_start", "char_end", F.col("tokens").cast("long").alias("tokens"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_table(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), away=held_out("doc_id", 7, 2), order=2)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_sharding": op4_sharding,
    "op5_warc_revisit": op5_warc_revisit,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_language_model": op12_language_model,
    "op13_token_alignment": op13_token_alignment,
}

_OP3 = r"""
WITH rows AS (
  SELECT doc_id AS id, coalesce('s' || source, 'z') AS skey, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
laid AS (
  SELECT *, substr(key, 1, 1) AS shard,
         CAST(coalesce(sum(size) OVER (PARTITION BY skey, substr(key, 1, 1) ORDER BY key, id NULLS FIRST, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows),
cells AS (SELECT skey, shard, CAST(sum(size) AS BIGINT) AS size FROM laid GROUP BY ALL),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM cells GROUP BY ALL),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM src),
levels AS (
  SELECT *, 3 * source_size / weight AS ratio,
         (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (
  SELECT *, CASE WHEN ratio <= level THEN CAST(3 * source_size AS DOUBLE)
                 ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target,
         greatest(1, least(CAST(ceil(total / CAST(20000 AS DOUBLE)) AS BIGINT), (min(CASE WHEN source_size > 0 THEN source_size END) OVER ()) // 4000)) AS block FROM levels),
cut AS (
  SELECT c.*, a.block, CASE WHEN c.size > 0 THEN greatest(1, CAST(round(c.size / CAST(a.block AS DOUBLE)) AS BIGINT)) ELSE 0 END AS n
  FROM cells c JOIN aimed a USING (skey)),
held AS (SELECT skey, sum(n) AS held FROM cut GROUP BY ALL),
quotients AS (
  SELECT skey, target / CAST(2 * k + 1 AS DOUBLE) AS quotient, k, CAST(round(total / CAST(block AS DOUBLE)) AS BIGINT) AS seats
  FROM (SELECT a.*, unnest(range(0, CAST(least(h.held * 3, 2 * ceil(a.target / a.block) + 50) AS BIGINT))) AS k FROM aimed a JOIN held h USING (skey))),
won AS (
  SELECT skey, count(*) AS source_quota
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, skey, k) AS place FROM quotients) WHERE place <= seats GROUP BY ALL),
per AS (
  SELECT c.*, a.source_size, a.target, coalesce(w.source_quota, 0) AS source_quota
  FROM cut c JOIN aimed a USING (skey) LEFT JOIN won w USING (skey)),
won2 AS (
  SELECT skey, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY size / CAST(2 * k + 1 AS DOUBLE) DESC, shard, k) AS place
        FROM (SELECT *, unnest(range(0, CAST(least(n * 3, 2 * ceil(source_quota * size / CAST(greatest(source_size, 1) AS DOUBLE)) + 50) AS BIGINT))) AS k FROM per))
  WHERE place <= source_quota GROUP BY ALL),
plan AS (
  SELECT p.*, coalesce(w.quota, 0) AS quota,
         CASE WHEN n > 0 THEN CAST('0x' || substr(md5('42|' || p.skey || '|' || p.shard), 1, 7) AS BIGINT) % n END AS turn
  FROM per p LEFT JOIN won2 w USING (skey, shard)),
spans AS (
  SELECT l.id, l.size, p.source_size, p.target, l.start, l.start + l.size AS fin, p.n, p.turn, p.size AS cell,
         CASE WHEN p.n > 0 THEN p.quota // p.n ELSE 0 END AS copies, CASE WHEN p.n > 0 THEN p.quota % p.n ELSE 0 END AS extra
  FROM laid l JOIN plan p USING (skey, shard))
SELECT id AS doc_id, size, source_size, target,
       CAST(copies * size + CASE WHEN size > 0 AND extra > 0 THEN
         greatest(0, least(fin, (least(turn + extra, n) * cell) // n) - greatest(start, (turn * cell) // n))
         + greatest(0, least(fin, (greatest(turn + extra - n, 0) * cell) // n) - start) ELSE 0 END AS BIGINT) AS taken
FROM spans
"""

_OP8 = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
exploded AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rows),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded),
common AS (
  SELECT key FROM (SELECT DISTINCT key, r FROM keyed WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

_OP5 = r"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest
  FROM rows),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k,
         first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS origin
  FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN origin END AS refers_to
FROM numbered
"""

_NEAREST = """
  SELECT r, p, CAST(min(d) AS BIGINT) AS d, CAST(arg_min(e, d * 64 + e) AS BIGINT) AS e
  FROM (SELECT x.r, x.p, c.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - c.x[i]) * (x.x[i] - c.x[i]))) AS d
        FROM parts x JOIN {book} c USING (p)) GROUP BY ALL"""

# the floor of sum / count: DuckDB's integer division cuts towards zero
_MOVED = """
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT x.p, a.e, unnest(x.x) AS v, unnest(range(len(x.x))) AS i FROM parts x JOIN {assigned} a USING (r, p)) GROUP BY ALL)
    GROUP BY ALL) m USING (p, e)"""

_OP11 = f"""
WITH ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM ints),
parts AS MATERIALIZED (
  SELECT r, p, v[CAST(p * (len(v) // 16) + 1 AS BIGINT) : CAST((p + 1) * (len(v) // 16) AS BIGINT)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT p, r AS e, x FROM parts WHERE r < 64),
assigned0 AS MATERIALIZED ({_NEAREST.format(book="book0")}),
book1 AS MATERIALIZED ({_MOVED.format(book="book0", assigned="assigned0")}),
assigned1 AS MATERIALIZED ({_NEAREST.format(book="book1")}),
book2 AS MATERIALIZED ({_MOVED.format(book="book1", assigned="assigned1")}),
assigned2 AS MATERIALIZED ({_NEAREST.format(book="book2")}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM assigned2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""

ORACLES = {"op3_mix_sources": _OP3, "op5_warc_revisit": _OP5, "op8_line_dedup": _OP8, "op11_vector_codes": _OP11}
