"""Registered queries: text functions, trigram / vector / hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.functions import text as TX
from cuefind.operators import hybrid as HY
from cuefind.operators import search as SE
from cuefind.operators.cosine import cosine_similarity
from cuefind.operators.admission import admit, result_links, with_titles
from cuefind.plans import duck as D
from cuefind.plans.registry import register
from cuefind.sources import testdata as TD

# ---------------------------------------------------------------- scalar text functions

@register("normalize_text", f"SELECT doc_id, {D.norm('text')} AS normalized_text FROM documents")
def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = TD.read(spark, sf, "documents")
    return docs.select("doc_id", TX.normalize_text(F.col("text")).alias("normalized_text"))


@register("strip_diacritics", "SELECT doc_id, strip_accents(text) AS stripped FROM documents")
def q_strip_diacritics(spark: SparkSession, sf: str) -> DataFrame:
    docs = TD.read(spark, sf, "documents")
    return docs.select("doc_id", TX.strip_diacritics(F.col("text")).alias("stripped"))


_URL_FORMS_SQL = f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
u AS (
  SELECT 'page' AS kind, page_id AS key, url FROM pages
  UNION ALL SELECT 'watch', conv_id, {D.WATCH} || {D.video_id('conv_id')} FROM c
  UNION ALL SELECT 'short', conv_id, 'https://youtu.be/' || {D.video_id('conv_id')} || '?si=x' FROM c
  UNION ALL SELECT 'embed', conv_id, {D.EMBED} || {D.video_id('conv_id * 7')} FROM c
  UNION ALL SELECT 'bad', conv_id, {D.WATCH} || CAST(conv_id AS VARCHAR) FROM c
)"""


@register("extract_video_id",
          _URL_FORMS_SQL + " SELECT kind, key, url, regexp_extract(url, '" + TX.VIDEO_ID_PATTERN + "', 1) "
                           "AS video_id FROM u")
def q_extract_video_id(spark: SparkSession, sf: str) -> DataFrame:
    pages = TD.read(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), "url")
    c = TD.read(spark, sf, "conversations").select("conv_id").distinct()
    vid = TD.video_id_of("conv_id")
    forms = [
        c.select(F.lit("watch").alias("kind"), F.col("conv_id").alias("key"), TX.watch_url(vid).alias("url")),
        c.select(F.lit("short"), F.col("conv_id"), F.concat(F.lit("https://youtu.be/"), vid, F.lit("?si=x"))),
        c.select(F.lit("embed"), F.col("conv_id"),
                 F.concat(F.lit(TX.EMBED_URL_PREFIX), TD.video_id_of(F.col("conv_id") * 7))),
        c.select(F.lit("bad"), F.col("conv_id"),
                 F.concat(F.lit(TX.WATCH_URL_PREFIX), F.col("conv_id").cast("string"))),
    ]
    u = pages
    for f in forms:
        u = u.unionByName(f.toDF("kind", "key", "url"))
    return u.select("kind", "key", "url", TX.extract_video_id(F.col("url")).alias("video_id"))


@register("trigram_similarity", f"""
SELECT a.conv_id, a.turn, round({D.jaccard(D.grams('a.text'), D.grams('b.text'))}, 6) AS similarity
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def q_trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each conversation turn with the following turn (whole texts).

    An equi-join on (conversation, turn + 1): no per-conversation window, so a very long
    conversation is spread over many tasks."""
    conv = TD.read(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = conv.join(nxt, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn",
                        F.round(TX.trigram_similarity(F.col("text"), F.col("next_text")), 6).alias("similarity"))


@register("vector_cosine", f"""
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
       AS cosine_similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_vector_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine similarity of each vector with the next vector id (an equi-join)."""
    e = TD.read(spark, sf, "embeddings").select("vec_id", "embedding")
    nb = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return e.join(nb, "vec_id").select(
        "vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("next_embedding")), 6)
        .alias("cosine_similarity"))


@register("query_admission", """
WITH q AS (
  SELECT 'benchmark' AS source, item_id AS key, text AS query FROM benchmark
  UNION ALL SELECT 'turn', conv_id * 4294967296 + turn, text FROM conversations
  UNION ALL SELECT 'event', event_id, event_type || ' ' || CAST(user_id AS VARCHAR) || '!' FROM events
),
m AS (SELECT *, length(query) + length(regexp_replace(query, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n16,
             query IS NULL OR regexp_replace(query, '[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+', '', 'g') = '' AS blank
      FROM q)
SELECT source, key,
       CASE WHEN blank THEN 'required' WHEN n16 > 64 THEN 'too_long' ELSE 'ok' END AS status,
       CASE WHEN blank OR n16 > 64 THEN NULL ELSE lower(query) END AS query
FROM m""")
def q_query_admission(spark: SparkSession, sf: str) -> DataFrame:
    b = TD.read(spark, sf, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("key"),
                                              F.col("text").alias("query"))
    t = TD.read(spark, sf, "conversations").select(F.lit("turn"), F.col("conv_id") * (1 << 32) + F.col("turn"),
                                                   F.col("text"))
    e = TD.read(spark, sf, "events").select(
        F.lit("event"), F.col("event_id"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit("!")))
    q = b.unionByName(t.toDF("source", "key", "query")).unionByName(e.toDF("source", "key", "query"))
    return admit(q).select("source", "key", "status", "query")


# ---------------------------------------------------------------- search

def _doc_search_inputs(spark: SparkSession, sf: str):
    chunks = TD.document_corpus(spark, sf, with_vectors=True)
    queries = TD.benchmark_queries(spark, sf, with_vectors=True)
    return chunks, queries


BENCH_Q_SQL = """SELECT b.item_id AS query_id, b.text AS query, e.embedding
      FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""


# the passages, and every twentieth document as a query for itself (its vector, if it has one)
SELF_Q_SQL = BENCH_Q_SQL + """
      UNION ALL
      SELECT -1 - d.doc_id, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
      WHERE d.doc_id % 20 = 0"""


def _self_search_inputs(spark: SparkSession, sf: str):
    chunks, queries = _doc_search_inputs(spark, sf)
    emb = TD.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    own = (TD.read(spark, sf, "documents").where(F.col("doc_id") % 20 == 0).join(emb, "doc_id", "left")
           .select((-1 - F.col("doc_id")).alias("query_id"), F.col("text").alias("query"), "embedding"))
    return chunks, queries.select("query_id", "query", "embedding").unionByName(own)


def doc_hybrid_ctes(q_sql: str = BENCH_Q_SQL) -> str:
    """CTEs c (corpus), q (queries), tri (trigram top 5), vec (vector top 5) for DuckDB."""
    return f"""
c AS (SELECT {D.chunk_id('d.doc_id')} AS chunk_id, {D.doc_video_id('d.doc_id')} AS video_id, d.text,
             {D.norm('d.text')} AS normalized_text, e.embedding, d.source || ' ' || CAST(d.doc_id AS VARCHAR) AS title
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
q AS ({q_sql}),
cg AS (SELECT chunk_id, {D.grams('normalized_text')} AS g FROM c WHERE normalized_text IS NOT NULL),
qg AS (SELECT query_id, {D.grams(D.norm('query'))} AS g FROM q),
ts AS (SELECT qg.query_id, cg.chunk_id, {D.jaccard('qg.g', 'cg.g')} AS score FROM qg CROSS JOIN cg),
tri AS (SELECT query_id, chunk_id, score AS trigram_score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS trigram_rank FROM ts
        QUALIFY trigram_rank <= 5),
vs AS (SELECT q.query_id, c.chunk_id, {D.cos_distance('c.embedding', 'q.embedding')} AS distance
       FROM q CROSS JOIN c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
vec AS (SELECT query_id, chunk_id, 1.0 - distance AS vector_score,
               row_number() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, chunk_id) AS vector_rank
        FROM vs QUALIFY vector_rank <= 5),
best AS (SELECT tri.query_id, tri.chunk_id, tri.trigram_score, vec.chunk_id IS NOT NULL AS is_common,
                row_number() OVER (PARTITION BY tri.query_id
                                   ORDER BY (vec.chunk_id IS NOT NULL) DESC, tri.trigram_rank) AS r
         FROM tri LEFT JOIN vec USING (query_id, chunk_id) QUALIFY r = 1)"""


_DOC_CORPUS_SQL = doc_hybrid_ctes()
_SELF_CORPUS_SQL = doc_hybrid_ctes(SELF_Q_SQL)


@register("trigram_topk", f"""
WITH cg AS (SELECT {D.chunk_id('doc_id')} AS chunk_id, {D.grams(D.norm('text'))} AS g FROM documents
            WHERE text IS NOT NULL),
qg AS (SELECT item_id AS query_id, {D.grams(D.norm('text'))} AS g FROM benchmark),
ts AS (SELECT qg.query_id, cg.chunk_id, {D.jaccard('qg.g', 'cg.g')} AS score FROM qg CROSS JOIN cg)
SELECT query_id, chunk_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM ts QUALIFY rank <= 5""")
def q_trigram_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 whole documents per benchmark passage by trigram similarity (all documents)."""
    chunks = TD.document_corpus(spark, sf, with_vectors=False)
    queries = TD.benchmark_queries(spark, sf, with_vectors=False)
    res = SE.trigram_topk(chunks, queries)
    return res.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register("vector_topk", "WITH " + _DOC_CORPUS_SQL +
          " SELECT query_id, chunk_id, round(1.0 - vector_score, 6) AS distance, vector_rank AS rank FROM vec")
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks, queries = _doc_search_inputs(spark, sf)
    res = SE.vector_topk(chunks, queries)
    return res.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@register("hybrid_common", "WITH " + _SELF_CORPUS_SQL +
          " SELECT tri.query_id, tri.chunk_id, round(trigram_score, 6) AS trigram_score, trigram_rank,"
          " round(vector_score, 6) AS vector_score, vector_rank FROM tri JOIN vec USING (query_id, chunk_id)")
def q_hybrid_common(spark: SparkSession, sf: str) -> DataFrame:
    return HY.hybrid_common(HY.sides(*_self_search_inputs(spark, sf))).select(
        "query_id", "chunk_id", F.round("trigram_score", 6).alias("trigram_score"), "trigram_rank",
        F.round("vector_score", 6).alias("vector_score"), "vector_rank")


@register("hybrid_scores", "WITH " + _SELF_CORPUS_SQL +
          " SELECT tri.query_id, tri.chunk_id, round((trigram_score + vector_score) / 2, 6) AS avg_score"
          " FROM tri JOIN vec USING (query_id, chunk_id)")
def q_hybrid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return HY.hybrid_scores(HY.sides(*_self_search_inputs(spark, sf))).select("query_id", "chunk_id", F.round("avg_score", 6).alias("avg_score"))


_HYBRID_BEST_SQL = "WITH " + _DOC_CORPUS_SQL + f"""
SELECT best.query_id, c.video_id, c.title, {D.WATCH} || c.video_id AS video_url,
       best.chunk_id, c.text AS chunk_text, 0 AS timestamp, round(best.trigram_score, 6) AS similarity_score, best.is_common,
       {D.WATCH} || c.video_id || '&t=0' AS link,
       {D.EMBED} || c.video_id || '?start=0' AS embed_url,
       {D.THUMB} || c.video_id || {D.THUMB_END} AS thumbnail_url
FROM best JOIN c USING (chunk_id)"""


@register("hybrid_best", _HYBRID_BEST_SQL)
def q_hybrid_best(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: best hybrid chunk per benchmark query, shaped as a search response."""
    chunks, queries = _doc_search_inputs(spark, sf)
    best = HY.hybrid_best(HY.sides(chunks, queries, payload=("video_id", "text", "start_ms")))
    # the winners carry their chunk; only their titles are joined
    shaped = result_links(with_titles(best.withColumnRenamed("text", "chunk_text"), TD.document_videos(spark, sf)))
    return shaped.select(
        "query_id", "video_id", "title", "video_url",
        "chunk_id", "chunk_text", "timestamp", F.round("similarity_score", 6).alias("similarity_score"), "is_common",
        "link", "embed_url", "thumbnail_url")
