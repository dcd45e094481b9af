"""Registered queries: cache roll-up, upsert, lookup, resolve, cached search, popular.

The request log comes from ``events`` (see testdata.query_log). The log is split in time
at the midpoint of its span: the earlier half built the cache, the later half is the
incoming batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.operators import cache as CA
from cuefind.operators.postings import build_index
from cuefind.plans import duck as D
from cuefind.plans.registry import ORACLE, register
from cuefind.plans.search_queries import doc_hybrid_ctes
from cuefind.session import reliable_checkpoint, scratch_path
from cuefind.sources import store as ST
from cuefind.sources import testdata as TD
from cuefind.streaming import cache_stream as CS

_Q = "event_type || ' ' || CAST(user_id AS VARCHAR) || '!'"
LOG_SQL = f"""
nlog AS (
  SELECT event_id, ts, user_id, query, {D.norm('query')} AS normalized_query, chunk_id
  FROM (SELECT event_id, ts, user_id,
               CASE WHEN event_id % 2 = 0 THEN upper({_Q}) ELSE {_Q} END AS query,
               {D.chunk_id('CAST(floor(value * 100) AS BIGINT)')} AS chunk_id
        FROM events)),
mid AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS m FROM events),
hist AS (SELECT * FROM nlog WHERE epoch_us(ts) < (SELECT m FROM mid)),
recent AS (SELECT * FROM nlog WHERE epoch_us(ts) >= (SELECT m FROM mid))"""


def _rollup_sql(src: str) -> str:
    return (f"SELECT normalized_query, arg_min(chunk_id, {{'t': ts, 'e': event_id}}) AS chunk_id, "
            f"min(ts) AS created_at, max(ts) AS last_accessed_at, count(*) AS access_count "
            f"FROM {src} GROUP BY normalized_query")


CACHE_SQL = LOG_SQL + f""",
cache AS ({_rollup_sql('hist')}),
delta AS ({_rollup_sql('recent')}),
incoming AS (SELECT normalized_query, arg_min(event_id, event_id) AS query_id,
                    lower(arg_min(query, event_id)) AS query, arg_min(user_id, event_id) AS user_id
             FROM recent GROUP BY normalized_query),
lookup AS (SELECT i.*, ca.chunk_id AS cached_chunk_id, ca.chunk_id IS NOT NULL AS hit
           FROM incoming i LEFT JOIN cache ca USING (normalized_query)),
corpus_ids AS (SELECT {D.chunk_id('d.doc_id')} AS chunk_id, {D.doc_video_id('d.doc_id')} AS video_id,
                      d.text AS chunk_text
               FROM documents d),
resolved AS (SELECT l.*, k.chunk_id IS NOT NULL AS resolved, k.video_id, k.chunk_text,
                    CASE WHEN k.chunk_id IS NOT NULL THEN 1.0 END AS similarity_score
             FROM lookup l LEFT JOIN corpus_ids k ON k.chunk_id = l.cached_chunk_id)"""


def _log(spark: SparkSession, sf: str):
    log = CA.with_normalized_query(TD.query_log(spark, sf))
    # one scalar (the split instant) comes back to the driver. ts is a wall-clock
    # TIMESTAMP_NTZ, so the split is computed and compared without any time zone.
    lo_hi = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    mid = lo_hi["lo"] + (lo_hi["hi"] - lo_hi["lo"]) // 2
    cut = F.lit(mid.isoformat(sep=" ")).cast("timestamp_ntz")
    return log, log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut)


def _incoming(recent: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("event_id", "query", "user_id"), "event_id")
    return recent.groupBy("normalized_query").agg(first.alias("f")).select(
        "normalized_query", F.col("f.event_id").alias("query_id"), F.lower("f.query").alias("query"),
        F.col("f.user_id").alias("user_id"))


@register("cache_rollup", "WITH " + LOG_SQL + ", r AS (" + _rollup_sql("nlog") + ") SELECT * FROM r")
def q_cache_rollup(spark: SparkSession, sf: str) -> DataFrame:
    log, _, _ = _log(spark, sf)
    return CA.cache_rollup(log)


@register("cache_upsert", "WITH " + CACHE_SQL + """
SELECT COALESCE(c.normalized_query, d.normalized_query) AS normalized_query,
       CASE WHEN d.normalized_query IS NOT NULL THEN d.chunk_id ELSE c.chunk_id END AS chunk_id,
       COALESCE(c.created_at, d.created_at) AS created_at,
       CASE WHEN d.normalized_query IS NOT NULL THEN d.last_accessed_at ELSE c.last_accessed_at END
         AS last_accessed_at,
       COALESCE(c.access_count, 0) + COALESCE(d.access_count, 0) AS access_count
FROM cache c FULL OUTER JOIN delta d ON c.normalized_query = d.normalized_query""")
def q_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    _, hist, recent = _log(spark, sf)
    return CA.cache_upsert(CA.cache_rollup(hist), CA.cache_rollup(recent))


@register("cache_lookup", "WITH " + CACHE_SQL +
          " SELECT query_id, normalized_query, hit, cached_chunk_id FROM lookup")
def q_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    _, hist, recent = _log(spark, sf)
    lk = CA.cache_lookup(_incoming(recent), CA.cache_rollup(hist))
    return lk.select("query_id", "normalized_query", "hit", "cached_chunk_id")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    _, hist, recent = _log(spark, sf)
    chunks = TD.document_corpus(spark, sf, with_vectors=False)
    lk = CA.cache_lookup(_incoming(recent), CA.cache_rollup(hist))
    return CA.cache_resolve(lk, chunks.withColumnRenamed("text", "chunk_text"), ("video_id", "chunk_text"))


@register("cache_resolve", "WITH " + CACHE_SQL +
          " SELECT query_id, normalized_query, cached_chunk_id, resolved, video_id, chunk_text, similarity_score"
          " FROM resolved")
def q_cache_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("query_id", "normalized_query", "cached_chunk_id", "resolved", "video_id", "chunk_text",
                      "similarity_score")


_MISS_Q = """SELECT r.query_id, r.query, e.embedding FROM resolved r
      LEFT JOIN embeddings e ON e.vec_id = r.user_id WHERE NOT r.resolved"""

_ANSWERS = doc_hybrid_ctes(_MISS_Q) + """,
answers AS (
  SELECT normalized_query, cached_chunk_id AS chunk_id, 1.0 AS similarity_score, 'cache' AS source
  FROM resolved WHERE resolved
  UNION ALL
  SELECT r.normalized_query, best.chunk_id, round(best.trigram_score, 6), 'search'
  FROM best JOIN resolved r USING (query_id))"""


# of the requests, every fiftieth is blank and the one after it over-long
_RECENT = "recent AS (SELECT * FROM nlog WHERE epoch_us(ts) >= (SELECT m FROM mid))"
_REQUEST_SQL = CACHE_SQL.replace(_RECENT, "came" + _RECENT[6:] + ", recent AS (SELECT * FROM came WHERE event_id % 50 > 1)")


def _requests(spark: SparkSession, sf: str):
    """(root of a store whose cache the earlier half of the log filled, the later half as requests)."""
    _, hist, recent = _log(spark, sf)
    root = scratch_path(spark, "search-store")
    ST.replace_table(CA.cache_rollup(hist), root, "query_cache")
    emb = TD.read(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    nth = F.pmod("event_id", F.lit(50))
    asked = F.when(nth == 0, F.lit(" \t")).when(nth == 1, F.repeat("query", F.lit(20))).otherwise(F.col("query"))
    requests = recent.select("event_id", "ts", "user_id", asked.alias("query")).join(emb, "user_id", "left").drop("user_id")
    return root, requests


@register("cached_search", "WITH " + _REQUEST_SQL + "," + _ANSWERS + f"""
SELECT n.event_id, 'ok' AS status, a.normalized_query, c.chunk_id, a.similarity_score, a.source, c.video_id, c.title,
       c.text AS chunk_text, 0 AS timestamp, {D.WATCH} || c.video_id || '&t=0' AS link
FROM recent n JOIN answers a ON a.normalized_query = n.normalized_query JOIN c ON c.chunk_id = a.chunk_id
UNION ALL
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'required' ELSE 'too_long' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM came WHERE event_id % 50 <= 1""")
def q_cached_search(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the request log, with blank and over-long requests, through the whole flow, one row per request."""
    root, requests = _requests(spark, sf)
    chunks = TD.document_corpus(spark, sf, with_vectors=True)
    out = CA.cached_search(spark, root, requests, chunks, TD.document_videos(spark, sf))
    return out.select("event_id", "status", "normalized_query", "chunk_id",
                      F.round("similarity_score", 6).alias("similarity_score"), "source", "video_id", "title",
                      "chunk_text", "timestamp", "link")


@register("cached_search_cache", "WITH " + _REQUEST_SQL + "," + _ANSWERS + """
SELECT COALESCE(k.normalized_query, d.normalized_query) AS normalized_query,
       COALESCE(a.chunk_id, k.chunk_id) AS chunk_id, COALESCE(k.created_at, d.created_at) AS created_at,
       COALESCE(d.last_accessed_at, k.last_accessed_at) AS last_accessed_at,
       COALESCE(k.access_count, 0) + COALESCE(d.access_count, 0) AS access_count
FROM cache k FULL OUTER JOIN delta d ON k.normalized_query = d.normalized_query
LEFT JOIN answers a ON a.normalized_query = d.normalized_query""")
def q_cached_search_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The cache table after that batch: hits counted, misses inserted, dangling entries replaced."""
    root, requests = _requests(spark, sf)
    CA.cached_search(spark, root, requests, TD.document_corpus(spark, sf, with_vectors=True), TD.document_videos(spark, sf))
    return ST.read_table(spark, root, "query_cache")


@register("stream_cached_search", ORACLE["cached_search_cache"])
def q_stream_cached_search(spark: SparkSession, sf: str) -> DataFrame:
    """The cache table after the later half of the log came in three parts, each a restart of the request stream;
    the last epoch is run twice."""
    root, requests = _requests(spark, sf)
    requests = reliable_checkpoint(requests)
    chunks, videos = TD.document_corpus(spark, sf, with_vectors=True), TD.document_videos(spark, sf)
    index = build_index(chunks)
    folder, answers, checkpoint = (scratch_path(spark, x) for x in ("requests", "answers", "search-ckpt"))
    lo, hi = requests.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * i // 3 for i in (1, 2)]
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    parts = [F.col("ts") < at(cuts[0]), (F.col("ts") >= at(cuts[0])) & (F.col("ts") < at(cuts[1])), F.col("ts") >= at(cuts[1])]
    for part in parts:
        requests.where(part).write.mode("append").parquet(folder)
        CS.run_search_stream(spark, folder, requests.schema, root, answers, checkpoint, chunks, videos, index=index)
    CS.answer_epoch(spark, requests.where(parts[-1]), 2, root, answers, chunks, videos, "search", index)      # changes nothing
    return ST.read_table(spark, root, "query_cache")


@register("stream_rollup", ORACLE["cache_rollup"])
def q_stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log rolled up as a stream of files, in two runs: the second brings rows that are
    earlier than those of the first, and starts from its checkpoint."""
    log = TD.query_log(spark, sf).select("event_id", "ts", "query", "chunk_id")
    folder, root, checkpoint = (scratch_path(spark, x) for x in ("log", "rollup-store", "rollup-ckpt"))
    late = F.col("event_id") % 3 == 0
    for part in (~late, late):
        log.where(part).repartition(2, "event_id").write.mode("append").parquet(folder)
        CS.run_rollup_stream(spark, folder, log.schema, root, checkpoint)
    return ST.read_table(spark, root, "query_cache")


@register("popular_queries", "WITH " + LOG_SQL + ", r AS (" + _rollup_sql("nlog") + """)
SELECT normalized_query, access_count FROM r ORDER BY access_count DESC, normalized_query LIMIT 10""")
def q_popular_queries(spark: SparkSession, sf: str) -> DataFrame:
    log, _, _ = _log(spark, sf)
    return CA.popular_queries(CA.cache_rollup(log), 10).select("normalized_query", "access_count")
