"""Query cache as a table: roll-up of a request log, upsert, lookup, resolve, cached search.

Keys are normalized queries. The in-process memory layer of the reference has no
counterpart: the table join is the cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefind.functions.text import normalize_text
from cuefind.operators.admission import admit, result_links, with_titles
from cuefind.operators.common import rows_with_keys
from cuefind.operators.hybrid import hybrid_best, sides
from cuefind.operators.search import TOP_K
from cuefind.session import reliable_checkpoint
from cuefind.sources.store import read_table, read_version, upsert_table, with_retries

CACHED_SCORE = 1.0  # fixed value: a cached answer is reported with similarity 1.0


def with_normalized_query(log: DataFrame, query_col: str = "query") -> DataFrame:
    return log.withColumn("normalized_query", normalize_text(F.col(query_col)))


def cache_rollup(log: DataFrame) -> DataFrame:
    """log(normalized_query, ts, event_id, chunk_id) -> cache entries: first request time,
    last request time, request count, and the first answer (by time, then event id).

    All four aggregates combine partially, so a hot query is pre-aggregated map-side."""
    return log.groupBy("normalized_query").agg(
        F.min_by("chunk_id", F.struct("ts", "event_id")).alias("chunk_id"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_accessed_at"),
        F.count(F.lit(1)).alias("access_count"),
    )


def cache_upsert(cache: DataFrame, delta: DataFrame) -> DataFrame:
    """Existing key: new chunk, new last access, count added; new key: inserted as is."""
    c, d = cache.alias("c"), delta.alias("d")
    j = c.join(d, F.col("c.normalized_query") == F.col("d.normalized_query"), "full_outer")
    hit = F.col("d.normalized_query").isNotNull()
    return j.select(
        F.coalesce("c.normalized_query", "d.normalized_query").alias("normalized_query"),
        F.when(hit, F.col("d.chunk_id")).otherwise(F.col("c.chunk_id")).alias("chunk_id"),
        F.coalesce("c.created_at", "d.created_at").alias("created_at"),
        F.when(hit, F.col("d.last_accessed_at")).otherwise(F.col("c.last_accessed_at")).alias("last_accessed_at"),
        (F.coalesce("c.access_count", F.lit(0)) + F.coalesce("d.access_count", F.lit(0))).alias("access_count"),
    )


def cache_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """queries(query_id, normalized_query, ...) + cached chunk_id (null on a miss) + hit. The cache is cut
    down to the batch's keys before the join, so it does not move for a bounded batch."""
    entries = rows_with_keys(cache.select("normalized_query", F.col("chunk_id").alias("cached_chunk_id")),
                             queries, "normalized_query")
    out = queries.join(entries, "normalized_query", "left")
    return out.withColumn("hit", F.col("cached_chunk_id").isNotNull())


def cache_resolve(lookup: DataFrame, chunks: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Resolve cached chunk ids against the chunk table; a dangling id is a miss. A resolved
    row carries the chunk ``payload`` columns and the cached score 1.0. The chunks are cut down to the
    cached ids before the join."""
    c = rows_with_keys(chunks.select(F.col("chunk_id").alias("cached_chunk_id"), *payload), lookup, "cached_chunk_id")
    out = lookup.join(c.withColumn("exists", F.lit(True)), "cached_chunk_id", "left")
    out = out.withColumn("resolved", F.coalesce(F.col("exists"), F.lit(False))).drop("exists")
    return out.withColumn("similarity_score", F.when(F.col("resolved"), F.lit(CACHED_SCORE)))


_PAYLOAD = ("video_id", "text", "start_ms")


def answer_batch(requests: DataFrame, cache: DataFrame, chunks: DataFrame, k: int = TOP_K,
                 index: DataFrame | None = None) -> DataFrame:
    """One row per normalized query of ``requests`` (normalized_query, query, embedding, ts, event_id, ...):
    ``chunk_id, similarity_score, source`` ('cache', 'search', or null if nothing is found) and the
    chunk's video_id, text, start_ms. A cached id that still exists answers; all others are searched."""
    first = F.min_by(F.struct("event_id", "query", "embedding"), F.struct("ts", "event_id"))
    asked = requests.groupBy("normalized_query").agg(first.alias("f")).select(
        "normalized_query", F.col("f.event_id").alias("query_id"), F.col("f.query").alias("query"),
        F.col("f.embedding").alias("embedding"))
    known = reliable_checkpoint(cache_resolve(cache_lookup(asked, cache), chunks, _PAYLOAD))
    hits = known.where("resolved").select("query_id", "normalized_query", F.col("cached_chunk_id").alias("chunk_id"),
                                          "similarity_score", F.lit("cache").alias("source"), *_PAYLOAD)
    missed = known.where("not resolved")
    best = hybrid_best(sides(chunks, missed.select("query_id", "query", "embedding"), k, payload=_PAYLOAD, index=index))
    found = missed.select("query_id", "normalized_query").join(best, "query_id", "left").select(
        "query_id", "normalized_query", "chunk_id", "similarity_score",
        F.when(F.col("chunk_id").isNotNull(), F.lit("search")).alias("source"), *_PAYLOAD)
    return hits.unionByName(found)


def cached_search(spark, root: str, requests: DataFrame, chunks: DataFrame, videos: DataFrame, k: int = TOP_K,
                  marks: dict[str, str] | None = None, before_commit: Callable[[DataFrame], None] | None = None,
                  index: DataFrame | None = None) -> DataFrame:
    """The whole request flow on a batch: admit, lower-case, look up, search what is missing, write back, shape.

    requests: event_id, ts (timestamp_ntz), query, embedding. Per request: ``event_id, status`` and, if it
    was admitted and answered, the answer with title, links and ``source``. The ``query_cache`` table under
    ``root`` gets its next version (the buckets of the batch's keys, with ``marks``): each admitted request counts
    once; hits keep their chunk, misses and dangling entries get the chunk found. A batch that fails leaves the
    table as it was. If another writer changes the table meanwhile, the batch is answered again from the new
    version. ``before_commit`` gets the shaped rows before the table changes. ``index``: the chunks' trigram
    index, if one is kept."""
    admitted = reliable_checkpoint(with_normalized_query(admit(requests)))
    ok = admitted.where("status = 'ok'")

    def answer() -> DataFrame:
        version = read_version(spark, root, "query_cache")
        answers = reliable_checkpoint(answer_batch(ok, read_table(spark, root, "query_cache", version), chunks, k, index))
        found = answers.where(F.col("chunk_id").isNotNull())
        delta = reliable_checkpoint(cache_rollup(ok.join(found.select("normalized_query", "chunk_id"), "normalized_query")))
        shaped = result_links(with_titles(found.drop("query_id").withColumnRenamed("text", "chunk_text"), videos))
        shaped = admitted.select("event_id", "status", "normalized_query").join(shaped, "normalized_query", "left")
        if before_commit:
            before_commit(shaped)
        upsert_table(spark, root, "query_cache", delta, lambda old: cache_upsert(old, delta), version, marks)
        return shaped

    return with_retries(answer)


def popular_queries(cache: DataFrame, k: int = 10) -> DataFrame:
    """Top-k entries by access count (desc), ties by key: the report is the feature."""
    return cache.orderBy(F.desc("access_count"), F.asc("normalized_query")).limit(k)
