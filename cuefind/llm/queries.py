"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuefind.llm import bond_negatives, bpe, hilbert_ann, line_runs, lsh_forest, mil_classifier, packing, quality_rules, splitters, substring_dedup, token_alignment, token_spans, warc_store
from cuefind.llm.common import table
from cuefind.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rows(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0, 20)


@_query
def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.rows(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = mil_classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return mil_classifier.rows(docs, model)


@_query
def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard_table(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "source", "text"), with_ids=False)


@_query
def op10_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.attribute(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op8_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_path(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), archive)
    return warc_store.archive_table(spark, archive)


@_query
def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.rows(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond_negatives.rows(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


@_query
def op13_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.rows(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE["op3_block_anchors"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p WHERE i + 19 <= len(w)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (
  SELECT p.doc_id, p.i, p.w[p.i] AS word,
         coalesce(max(CASE WHEN r.again THEN 1 ELSE 0 END)
           OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM p LEFT JOIN r USING (doc_id, i)
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE["op6_lsh_forest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE common >= 0.8 * (a.size + b.size - common)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), k AS (
  SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x
)
SELECT k.doc_id, k.class_id, (SELECT count(*) FROM l WHERE l.x = k.doc_id) AS n_links FROM k
"""

ORACLE["op8_warc_store"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

ORACLE["op11_line_runs"] = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, row_no, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), g AS (
  SELECT k.*, r.last_doc IS NOT NULL AND k.doc_id < r.last_doc AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id, row_no
"""

ORACLE["op12_bond_negatives"] = """
WITH e AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT * FROM e WHERE vec_id % 50 = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM a JOIN e b ON a.row_no <> b.row_no
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM (
  SELECT p.*, s.other_id, s.score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
) WHERE rank <= 3
"""
