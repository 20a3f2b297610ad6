"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, html_text, packing, pieces, quality, repair, simhash, substring, suffix, toxicity, vectors
from .common import table


def op1_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_documents(repair.write_blocks(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1))


def op2_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(table(spark, sf_dir, "documents"), distance=4, width=4)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *quality.METRICS, "base_failed", "kept")


def op4_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"), limit=0.9)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024), capacity=1024)


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(table(spark, sf_dir, "documents"), length=100)


def op7_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), PATTERN)


def op8_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op11_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


OP3_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM b GROUP BY source
), p AS (
  SELECT sum(failed) / sum(n) AS m,
         sum(n * (failed / n) * (failed / n)) / sum(n) - (sum(failed) / sum(n)) * (sum(failed) / sum(n))
           - (sum(failed) / sum(n)) * (1 - sum(failed) / sum(n)) * count(*) / sum(n) AS v
  FROM h
), s AS (
  SELECT m, CASE WHEN v > 0 THEN greatest({quality.PRIOR_MIN}, least({quality.PRIOR_MAX}, m * (1 - m) / v - 1)) ELSE {quality.PRIOR_MAX} END AS s FROM p
), r AS (
  SELECT source AS host, (failed + m * s) / (n + s) >= {quality.HOST_LIMIT} AS host_rejected FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.host
"""


#: Cosines of all pairs; components from all pairs that reach each other (few vectors are that alike).
OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), d AS (
  SELECT len(v) AS dim FROM e WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, dim LIMIT 1
), good AS (
  SELECT row_number() OVER () AS r, vec_id, v FROM e, d
  WHERE len(v) = dim AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM good a JOIN good b ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT a, vb FROM links UNION SELECT reach.a, links.vb FROM reach JOIN links ON reach.vb = links.va
), n AS (
  SELECT va AS vec_id, count(*) AS n_links FROM links GROUP BY 1
), c AS (
  SELECT vec_id, min(vb) AS least FROM reach JOIN good ON good.r = reach.a GROUP BY 1
)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id))::BIGINT AS component_id, coalesce(c.least, e.vec_id) >= e.vec_id AS kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Windows of 100 bytes as hex digits, taken from blocks of 500 starts, grouped by their MD5.
OP6_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 99)::BIGINT, 500)) AS p FROM t)
), s AS (
  SELECT doc_id, p, h, unnest(range(0, (length(h) // 2 - 99)::BIGINT)) AS j FROM b
), w AS (
  SELECT doc_id, p + j AS i, row_number() OVER (PARTITION BY md5(substr(h, 2 * j + 1, 200)) ORDER BY doc_id, p + j) AS place FROM s
), g AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS opens FROM w WHERE place > 1
), k AS (
  SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), r AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY 1, 2
), u AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1
), edge AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r
  UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY 1
), left_of AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM edge JOIN t USING (doc_id) GROUP BY 1
)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(left_of.h, t.h))) AS kept_sha256
FROM t LEFT JOIN u USING (doc_id) LEFT JOIN left_of USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and "_" in k and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_host_quality": OP3_SQL, "op4_pivot_permutation": OP4_SQL, "op6_difference_cover": OP6_SQL}
