"""Registered queries: only-missing ingest, missing report, video upsert, ingest counts.

Scenario over the conversations table: every conversation is a listed video; videos of
conversations with a system turn were stored by an earlier run (with an old title and no
transcript yet); every third conversation has a subtitle file; a speech-to-text script exists for
conversations of at least three turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.functions.text import watch_url
from cuefind.operators import chunking as CH
from cuefind.operators import ingest as IN
from cuefind.plans import duck as D
from cuefind.plans.chunk_queries import CHUNKS_SQL, SEGMENTS_SQL
from cuefind.plans.fetch_job import upsert_scripts
from cuefind.plans.registry import register
from cuefind.plans.source_queries import SUBTITLE_SQL
from cuefind.session import reliable_checkpoint, scratch_path
from cuefind.sources import fixture_files as FF
from cuefind.sources import store as ST
from cuefind.sources import subtitles as SU
from cuefind.sources import testdata as TD

_VID = D.video_id("conv_id")
SCENARIO_SQL = SEGMENTS_SQL + f""",
sub AS (SELECT * FROM ({SUBTITLE_SQL}) WHERE CAST(video_id AS BIGINT) % 3 = 0),
listing AS (SELECT DISTINCT {_VID} AS video_id, 'conv ' || CAST(conv_id AS VARCHAR) AS title,
                   {D.WATCH} || {_VID} AS video_url FROM conversations),
stored AS (SELECT DISTINCT {_VID} AS video_id, 'old conv ' || CAST(conv_id AS VARCHAR) AS title,
                  {D.WATCH} || {_VID} AS video_url, '' AS transcript,
                  'subtitles' AS extraction_type, 0 AS n_segments
           FROM conversations WHERE role = 'system'),
spoken AS (SELECT {_VID} AS video_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3),
pieces AS (SELECT video_id, seq AS pos, text, 'subtitles' AS extraction_type FROM sub
           UNION ALL
           SELECT video_id, pos, text, 'stt' FROM seg
           WHERE video_id IN (SELECT video_id FROM spoken) AND video_id NOT IN (SELECT video_id FROM sub)),
scripts AS (SELECT video_id, extraction_type, {D.trim_ws("string_agg(text, '' ORDER BY pos)")} AS transcript,
                   count(*) AS n_segments
            FROM pieces GROUP BY video_id, extraction_type),
missing AS (SELECT * FROM listing WHERE video_id NOT IN (SELECT video_id FROM stored)),
processed AS (SELECT * FROM missing WHERE video_id IN (SELECT video_id FROM scripts)),
after AS (SELECT video_id FROM stored UNION SELECT video_id FROM processed)"""


def _scenario(spark: SparkSession, sf: str):
    """(listing, stored videos, what ``choose_scripts`` needs: subtitle files, their segments, speech)."""
    conv = TD.read(spark, sf, "conversations").select("conv_id", "role")
    listing = TD.conversation_videos(spark, sf)
    sys_ids = conv.where(F.col("role") == "system").select("conv_id").distinct()
    vid = TD.video_id_of("conv_id")
    stored = sys_ids.select(
        vid.alias("video_id"), F.concat(F.lit("old conv "), F.col("conv_id").cast("string")).alias("title"),
        watch_url(vid).alias("video_url"), F.lit("").alias("transcript"), F.lit("subtitles").alias("extraction_type"))
    spoken = conv.groupBy("conv_id").count().where(F.col("count") >= 3).select(vid.alias("video_id"))
    stt = TD.conversation_segments(spark, sf).join(spoken, "video_id", "left_semi")
    files = FF.subtitle_file_rows(spark, sf).where(F.col("video_id").cast("long") % 3 == 0)
    return listing, stored, (files, SU.parse_subtitles(files), stt)


def _scripted(spark: SparkSession, sf: str):
    """Ids of videos with a script of either kind."""
    listing, stored, (files, _, stt) = _scenario(spark, sf)
    return listing, stored, files.select("video_id").unionByName(stt.select("video_id")).distinct()


@register("script_choice", "WITH " + SCENARIO_SQL + """
SELECT video_id, extraction_type, transcript, CAST(n_segments AS BIGINT) AS n_segments FROM scripts
WHERE video_id IN (SELECT video_id FROM missing)""")
def q_script_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitles where a subtitle file exists, else speech-to-text, for the videos not stored yet."""
    listing, stored, sources = _scenario(spark, sf)
    choice = IN.choose_scripts(IN.ingest_missing(listing, stored), *sources)
    counts = IN.script_segments(choice).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return (IN.scripts_from_segments(choice).join(counts, "video_id", "left")
            .withColumn("n_segments", F.coalesce("n_segments", F.lit(0))))


@register("ingest_missing", "WITH " + SCENARIO_SQL + " SELECT video_id, title, video_url FROM missing")
def q_ingest_missing(spark: SparkSession, sf: str) -> DataFrame:
    listing, stored, _ = _scenario(spark, sf)
    return IN.ingest_missing(listing, stored).select("video_id", "title", "video_url")


@register("missing_report", "WITH " + SCENARIO_SQL +
          " SELECT video_id, title FROM listing WHERE video_id NOT IN (SELECT video_id FROM after)")
def q_missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return IN.missing_report(*_scripted(spark, sf)).select("video_id", "title")


@register("video_upsert", "WITH " + SCENARIO_SQL + """
SELECT COALESCE(s.video_id, n.video_id) AS video_id, COALESCE(s.title, n.title) AS title,
       COALESCE(s.video_url, n.video_url) AS video_url,
       CASE WHEN n.video_id IS NOT NULL THEN n.transcript ELSE s.transcript END AS transcript,
       COALESCE(s.extraction_type, n.extraction_type) AS extraction_type,
       CAST(CASE WHEN n.video_id IS NOT NULL THEN n.n_segments ELSE s.n_segments END AS BIGINT) AS n_segments
FROM stored s FULL OUTER JOIN (SELECT l.video_id, l.title, l.video_url, sc.transcript, sc.extraction_type, sc.n_segments
                               FROM listing l JOIN scripts sc USING (video_id)) n ON s.video_id = n.video_id""")
def q_video_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Re-extract every listed video (only-missing off) and upsert into the stored tables."""
    listing, stored, sources = _scenario(spark, sf)
    root = scratch_path(spark, "upsert-store")
    ST.replace_table(stored, root, "videos")
    listing = reliable_checkpoint(listing)
    upsert_scripts(spark, root, listing, reliable_checkpoint(IN.choose_scripts(listing, *sources)))
    counts = ST.read_table(spark, root, "segments").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return ST.read_table(spark, root, "videos").join(counts, "video_id", "left").select(
        "video_id", "title", "video_url", "transcript", "extraction_type",
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"))


@register("ingest_stats", "WITH " + SCENARIO_SQL + """
SELECT (SELECT count(*) FROM listing) AS listed, (SELECT count(*) FROM stored) AS stored_before,
       (SELECT count(*) FROM missing) AS to_process, (SELECT count(*) FROM processed) AS processed,
       (SELECT count(*) FROM listing WHERE video_id NOT IN (SELECT video_id FROM after)) AS missing_after""")
def q_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return IN.ingest_stats(*_scripted(spark, sf))


@register("replace_chunks", "WITH " + CHUNKS_SQL + """
SELECT chunk_id, video_id, text, CAST(video_id AS BIGINT) % 2 = 0 AS fresh FROM chunks
UNION ALL
SELECT video_id || '-old', video_id, 'an old chunk', false FROM (SELECT DISTINCT video_id FROM seg)
WHERE CAST(video_id AS BIGINT) % 2 = 1""")
def q_replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every video has one old chunk, odd ones their present chunks too; even videos are chunked anew: their
    old chunks go."""
    even = F.col("video_id").cast("long") % 2 == 0
    seg = TD.conversation_segments(spark, sf)
    cols = ["chunk_id", "video_id", "text"]
    old = seg.select("video_id").distinct().select(
        F.concat("video_id", F.lit("-old")).alias("chunk_id"), "video_id", F.lit("an old chunk").alias("text"))
    stored = old.unionByName(CH.chunk_segments(seg.where(~even)).select(*cols)).withColumn("fresh", F.lit(False))
    fresh = CH.chunk_segments(seg.where(even)).select(*cols).withColumn("fresh", F.lit(True))
    return CH.replace_chunks(stored, fresh)
