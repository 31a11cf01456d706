"""Queries of the subpackage: ``opN_<name>``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import embedding_dedup, hard_negatives, language_id, lexical_packing, masked_lm, packing, quality, sentencepiece_codec, simhash, source_audit, suffix_dedup, toxicity, warc
from factlake.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_digest(docs, tokenizer_path("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "body")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenise(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024)
    return packing.pack(pieces, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector has a wrong label, as a stand-in for noise; every fiftieth is an anchor."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_sentencepiece, op3_simhash, op4_toxicity, op5_packing, op6_quality, op7_embeddings, op8_warc, op9_language, op10_masked_lm, op11_retrieval_packing, op12_source_audit, op13_hard_negatives)}


#: The contract of op8 in DuckDB's SQL; payloads are compared whole there.
OP8_SQL = """
SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha256(p) AS payload_digest,
  CASE WHEN octet_length(encode(p)) >= 100 AND page_id > m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(p)) >= 100 AND page_id > m THEN m END AS refers_to
FROM (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS m FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""


#: The contract of op12; every kept word is evaluated for every pair.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
  w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
  k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
  g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
  p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)::HUGEINT) // (total + 2 * v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (any_value(all_n) + 2 * any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
  x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""

#: The contract of op13; every anchor meets every row.
OP13_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
  p AS (SELECT a, b AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, positive_id, row_number() OVER (PARTITION BY a, positive_id ORDER BY s DESC, b)::INT AS rank, b AS negative_id, positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 100 * s BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY a, positive_id ORDER BY s DESC, b) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op12_source_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
