"""The queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, neardup, pages, pii, quality, sharding, substring_dedup, suffix_dedup, tokens
from .common import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.read_records(tokens.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_duplicates(table(spark, sf_dir, "documents")).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(spread(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(spread(table(spark, sf_dir, "documents"))).drop("hilbert")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_tokens, op2_suffix, op3_mixing, op4_decontaminate, op5_sharding, op6_pii, op7_pages, op8_substring, op9_neardup, op10_quality)}

ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op4_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)
), o AS (
  SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), h AS (
  SELECT o.doc_id, o.k, p.m, p.item_id FROM o JOIN p ON o.m = p.m AND o.s = p.s
), n AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS j FROM h) GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
""",
    "op2_suffix": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, c, substr(h, CAST(1000 * c + 1 AS BIGINT), 1398) AS h FROM (SELECT doc_id, h, unnest(generate_series(0, (len(h) // 2 - 200) // 500)) AS c FROM d WHERE len(h) >= 400)
), w AS (
  SELECT doc_id, 500 * c + j AS k, md5_number(substr(h, CAST(2 * j - 1 AS BIGINT), 400)) AS s FROM (SELECT doc_id, c, h, unnest(generate_series(1, len(h) // 2 - 199)) AS j FROM p)
), r AS (
  SELECT doc_id, k FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)
), i AS (
  SELECT doc_id, k, sum(CASE WHEN k - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM r)
), runs AS (
  SELECT doc_id, min(k) AS a, max(k) + 199 AS b FROM i GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a - 1 AS y FROM runs
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), max(len(h)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
), n AS (
  SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op8_substring": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, k, md5_number(array_to_string(w[k : k + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)
), f AS (
  SELECT s, min(doc_id) AS first FROM s GROUP BY s
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(k, k + 49)) AS p FROM s JOIN f USING (s) WHERE first < doc_id
), a AS (
  SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d
), k AS (
  SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.p) AS t FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op9_neardup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[k : k + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), j AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
