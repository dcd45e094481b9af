"""Hybrid search: trigram top-k combined with vector top-k per query.

Semantics: the winner is the best trigram-ranked chunk that is also in the vector top-k;
if there is none, trigram rank 1. The score is the trigram score; a vector-only chunk
never wins. The mean of both scores on common chunks is exposed but decides nothing.

Both sides come from one scan (``search``); ``sides`` brings them together with one aggregate
per (query, chunk), so the scoring plan appears once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefind.operators.common import top_k_per_key
from cuefind.operators.embed import PAUSE_S, embed_texts
from cuefind.operators.search import TOP_K, TRIGRAM, VECTOR, search


def sides(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, payload: tuple[str, ...] = (),
          index: DataFrame | None = None) -> DataFrame:
    """One row per (query, chunk) of either top-k list: ``trigram_score, trigram_rank, vector_score,
    vector_rank`` (null where the chunk is not in that list) and the payload."""
    found = search(chunks, queries, k, payload=tuple(payload), index=index)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    merged = found.groupBy("query_id", "chunk_id").agg(
        of(TRIGRAM, "value").alias("trigram_score"), of(TRIGRAM, "rank").alias("trigram_rank"),
        (F.lit(1.0) - of(VECTOR, "value")).alias("vector_score"), of(VECTOR, "rank").alias("vector_rank"),
        *(F.first(c).alias(c) for c in payload))
    return merged


def hybrid_common(merged: DataFrame) -> DataFrame:
    """Chunks present in both top-k lists (an intersect on the pair key)."""
    return merged.where(F.col("trigram_rank").isNotNull() & F.col("vector_rank").isNotNull())


def hybrid_scores(merged: DataFrame) -> DataFrame:
    return hybrid_common(merged).withColumn("avg_score", (F.col("trigram_score") + F.col("vector_score")) / 2)


def hybrid_best(merged: DataFrame) -> DataFrame:
    """One row per query: ``similarity_score, is_common`` beside the columns of ``sides``."""
    both = merged.where(F.col("trigram_rank").isNotNull()).withColumn("is_common", F.col("vector_rank").isNotNull())
    best = top_k_per_key(both, "query_id", [F.desc("is_common"), F.asc("trigram_rank")], 1)
    return best.drop("rank").withColumn("similarity_score", F.col("trigram_score"))


def search_by_text(chunks: DataFrame, queries: DataFrame, provider, k: int = TOP_K, pause_s: float = PAUSE_S) -> DataFrame:
    """The search flow for raw query text: each query is embedded with the same provider as the
    chunks (batched on the executors), then both top-k lists are merged by ``hybrid_best``."""
    vectors = embed_texts(queries.select("query_id", "query"), provider, id_col="query_id", text_col="query", pause_s=pause_s)
    with_vec = queries.select("query_id", "query").join(vectors, "query_id", "left")
    return hybrid_best(sides(chunks, with_vec, k))
