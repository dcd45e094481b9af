"""Registered queries: chunking, transcripts, unchunked videos, search over real chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.operators import chunking as CH
from cuefind.operators import search as SE
from cuefind.operators.admission import result_links
from cuefind.plans import duck as D
from cuefind.plans.registry import register
from cuefind.session import written
from cuefind.sources import testdata as TD

SEGMENTS_SQL = f"""
seg AS (
  SELECT {D.video_id('conv_id')} AS video_id, p AS pos, text, p * 400 AS start_ms, p * 400 + 400 AS end_ms
  FROM (SELECT conv_id, CAST(first + unnest(range(len(l))) AS BIGINT) AS p, unnest(l) AS text
        FROM (SELECT conv_id, l, coalesce(sum(len(l)) OVER (PARTITION BY conv_id ORDER BY turn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
              FROM (SELECT conv_id, turn, string_split_regex(text, '[ \\n]+') AS l FROM conversations))))"""


def _threshold_sql(t: int) -> str:
    return f"""
f{t} AS (
  SELECT video_id, pos, start_ms, lastp,
         list_sort(list({{'pos': pos, 't': text, 'e': end_ms}}) OVER (PARTITION BY video_id ORDER BY cb
              RANGE BETWEEN CURRENT ROW AND {t - 1} FOLLOWING)) AS m0
  FROM base),
k{t} AS (
  SELECT video_id, {t} AS threshold, pos, {D.trim_ws("array_to_string(list_transform(m, lambda x: x.t), ' ')")} AS text,
         start_ms, m[-1].e AS end_ms, m[-1].pos AS end_pos, m[-1].pos = lastp AS reaches_end
  FROM (SELECT *, list_filter(m0, lambda x: x.pos >= pos) AS m FROM f{t}))"""


CHUNKS_SQL = SEGMENTS_SQL + f""",
base AS (
  SELECT *, COALESCE(SUM({D.len16('text')}) OVER (PARTITION BY video_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
         MAX(pos) OVER (PARTITION BY video_id) AS lastp
  FROM seg),""" + _threshold_sql(30) + "," + _threshold_sql(50) + f""",
d30 AS (SELECT *, row_number() OVER (PARTITION BY video_id, text, start_ms, end_ms ORDER BY pos) > 1 AS dup FROM k30),
e30 AS (SELECT * FROM (SELECT *, MIN(CASE WHEN reaches_end AND NOT dup THEN pos END)
                                   OVER (PARTITION BY video_id) AS stop FROM d30)
        WHERE NOT dup AND (stop IS NULL OR pos <= stop)),
d50 AS (SELECT k.*, (row_number() OVER (PARTITION BY k.video_id, k.text, k.start_ms, k.end_ms ORDER BY k.pos) > 1)
                    OR (e.video_id IS NOT NULL) AS dup
        FROM k50 k LEFT JOIN (SELECT DISTINCT video_id, text, start_ms, end_ms FROM e30) e
             ON e.video_id = k.video_id AND e.text = k.text AND e.start_ms = k.start_ms AND e.end_ms = k.end_ms),
e50 AS (SELECT * FROM (SELECT *, MIN(CASE WHEN reaches_end AND NOT dup THEN pos END)
                                   OVER (PARTITION BY video_id) AS stop FROM d50)
        WHERE NOT dup AND (stop IS NULL OR pos <= stop)),
chunks AS (
  SELECT video_id || '-' || CAST(threshold AS VARCHAR) || '-' || {D.padded('pos', 10)} AS chunk_id,
         video_id, threshold, pos, text, {D.norm('text')} AS normalized_text, start_ms, end_ms, end_pos
  FROM (SELECT video_id, threshold, pos, text, start_ms, end_ms, end_pos FROM e30
        UNION ALL SELECT video_id, threshold, pos, text, start_ms, end_ms, end_pos FROM e50))"""


def conversation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return CH.chunk_segments(written(TD.conversation_segments(spark, sf)))


@register("chunk_segments", "WITH " + CHUNKS_SQL + " SELECT * FROM chunks")
def q_chunk_segments(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_chunks(spark, sf)


@register("video_transcript", "WITH " + SEGMENTS_SQL + f"""
SELECT video_id, {D.trim_ws("string_agg(text, '' ORDER BY pos)")} AS transcript FROM seg GROUP BY video_id""")
def q_video_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return CH.video_transcripts(TD.conversation_segments(spark, sf))


# Videos chunked by an earlier run: conversations that open with a system turn.
_EARLIER_SQL = "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'"


@register("videos_unchunked", "WITH " + CHUNKS_SQL + f""",
earlier AS (SELECT * FROM chunks WHERE CAST(video_id AS BIGINT) IN ({_EARLIER_SQL}))
SELECT DISTINCT {D.video_id('conv_id')} AS video_id, 'conv ' || CAST(conv_id AS VARCHAR) AS title
FROM conversations WHERE {D.video_id('conv_id')} NOT IN (SELECT video_id FROM earlier)""")
def q_videos_unchunked(spark: SparkSession, sf: str) -> DataFrame:
    conv = TD.read(spark, sf, "conversations")
    earlier_ids = conv.where(F.col("role") == "system").select(TD.video_id_of("conv_id").alias("video_id")).distinct()
    seg = TD.conversation_segments(spark, sf).join(earlier_ids, "video_id", "left_semi")
    stored = CH.chunk_segments(seg)
    videos = TD.conversation_videos(spark, sf)
    return CH.videos_unchunked(videos, stored).select("video_id", "title")


@register("chunk_trigram_topk", "WITH " + CHUNKS_SQL + f""",
cg AS (SELECT chunk_id, {D.grams('normalized_text')} AS g FROM chunks WHERE normalized_text IS NOT NULL),
qg AS (SELECT item_id AS query_id, {D.grams(D.norm('text'))} AS g FROM benchmark),
ts AS (SELECT qg.query_id, cg.chunk_id, {D.jaccard('qg.g', 'cg.g')} AS score FROM qg CROSS JOIN cg),
top AS (SELECT query_id, chunk_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts
        QUALIFY rank <= 5)
SELECT top.query_id, top.chunk_id, round(top.score, 6) AS score, top.rank, c.video_id, c.start_ms,
       c.text AS chunk_text
FROM top JOIN chunks c USING (chunk_id)""")
def q_chunk_trigram_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 conversation chunks per benchmark passage (trigram), with chunk payload."""
    chunks = conversation_chunks(spark, sf).withColumnRenamed("text", "chunk_text")
    queries = TD.benchmark_queries(spark, sf, with_vectors=False)
    top = SE.trigram_topk(chunks, queries, payload=("video_id", "start_ms", "chunk_text"))
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "video_id", "start_ms",
                      "chunk_text")


@register("result_links", "WITH " + CHUNKS_SQL + f"""
SELECT chunk_id, video_id, CAST(floor(start_ms / 1000) AS INTEGER) AS timestamp,
       {D.WATCH} || video_id || '&t=' || CAST(CAST(floor(start_ms / 1000) AS INTEGER) AS VARCHAR)
         AS link,
       {D.EMBED} || video_id || '?start='
         || CAST(CAST(floor(start_ms / 1000) AS INTEGER) AS VARCHAR) AS embed_url,
       {D.THUMB} || video_id || {D.THUMB_END} AS thumbnail_url
FROM chunks""")
def q_result_links(spark: SparkSession, sf: str) -> DataFrame:
    """Response links (watch &t=, embed ?start=, thumbnail) for every chunk."""
    chunks = conversation_chunks(spark, sf).select("chunk_id", "video_id", "start_ms")
    videos = TD.conversation_videos(spark, sf).select("video_id", "video_url")
    shaped = result_links(chunks.join(videos, "video_id"))
    return shaped.select("chunk_id", "video_id", "timestamp", "link", "embed_url", "thumbnail_url")
