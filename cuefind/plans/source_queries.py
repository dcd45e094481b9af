"""Registered queries: listing scan, subtitle parse, segment JSON codec, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuefind.operators import chunking as CH
from cuefind.plans import duck as D
from cuefind.plans.chunk_queries import SEGMENTS_SQL
from cuefind.plans.registry import register
from cuefind.session import scratch_path
from cuefind.sources import fixture_files as FF
from cuefind.sources import listing as LI
from cuefind.sources import store as ST
from cuefind.sources import subtitles as SU
from cuefind.sources import testdata as TD

WS = D.WS

LISTING_SQL = f"""
SELECT DISTINCT {D.video_id('conv_id')} AS video_id, 'conv ' || CAST(conv_id AS VARCHAR) AS title,
       {D.WATCH} || {D.video_id('conv_id')} AS video_url
FROM conversations"""


@register("playlist_scan", LISTING_SQL)
def q_playlist_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = FF.write_listing(spark, sf)
    listing = LI.read_listings(spark, path)
    return LI.first_listing_per_video(listing).select("video_id", "title", "video_url")


@register("playlist_dedupe", f"""
SELECT {D.video_id('conv_id')} AS video_id, 0 AS playlist, 'conv ' || CAST(conv_id AS VARCHAR) AS title
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0
UNION ALL
SELECT {D.video_id('conv_id')}, 1, 'second conv ' || CAST(conv_id AS VARCHAR)
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 <> 0""")
def q_playlist_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Two playlists: the first lists every second video, the second all of them under another title."""
    paths = [FF.write_listing(spark, sf, "conv ", F.col("conv_id") % 2 == 0), FF.write_listing(spark, sf, "second conv ")]
    return LI.first_listing_per_video(LI.read_listings(spark, paths)).select("video_id", "playlist", "title")


SUBTITLE_SQL = f"""
WITH t AS (
  SELECT {D.video_id('conv_id')} AS video_id, turn,
         array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{WS}+', '', 'g') <> ''),
                         ' ') AS text,
         CAST(turn * 400000 AS BIGINT) AS start_ms, CAST(turn * 400000 + 399000 AS BIGINT) AS end_ms
  FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn) AS seq FROM t),
n AS (SELECT video_id, count(*) AS n FROM r GROUP BY video_id)
SELECT video_id, seq, text, start_ms, end_ms FROM r
UNION ALL
SELECT r.video_id, n.n + 1 AS seq, r.text, r.start_ms, r.end_ms FROM r JOIN n USING (video_id) WHERE r.seq = 1"""


def subtitle_segments(spark: SparkSession, sf: str) -> DataFrame:
    path = FF.write_subtitles(spark, sf)
    return SU.parse_subtitle_lines(SU.read_subtitle_lines(spark, path))


@register("subtitle_segments", SUBTITLE_SQL)
def q_subtitle_segments(spark: SparkSession, sf: str) -> DataFrame:
    seg = subtitle_segments(spark, sf)
    seq = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    return seg.select("video_id", seq.alias("seq"), "text", "start_ms", "end_ms")


@register("segments_json_roundtrip", "WITH " + SEGMENTS_SQL +
          " SELECT video_id, pos, text, start_ms, end_ms FROM seg")
def q_segments_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Segments -> stored JSON text per video -> parsed back; must equal the input."""
    seg = TD.conversation_segments(spark, sf)
    per_video = seg.groupBy("video_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text", "start_ms", "end_ms"))).alias("s"))
    as_json = per_video.select("video_id", F.col("s.pos").alias("p"), ST.segments_to_json(F.col("s")).alias("js"))
    back = as_json.select("video_id", F.arrays_zip(F.col("p").alias("pos"),
                                                   ST.segments_from_json(F.col("js")).alias("seg")).alias("z"))
    return back.select("video_id", F.explode("z").alias("z")).select(
        "video_id", "z.pos", "z.seg.text", "z.seg.start_ms", "z.seg.end_ms")


EXPORT_SQL = "WITH " + SEGMENTS_SQL + f""",
tr AS (SELECT video_id, {D.trim_ws("string_agg(text, '' ORDER BY pos)")} AS transcript,
              string_agg(text || '|' || {D.timespan('start_ms')} || '|' || {D.timespan('end_ms')}, ';' ORDER BY pos)
                AS segments
       FROM seg GROUP BY video_id)
SELECT video_id, 'conv ' || CAST(CAST(video_id AS BIGINT) AS VARCHAR) AS title,
       {D.WATCH} || video_id AS video_url, transcript, 0 AS extraction_type,
       segments
FROM tr"""


def build_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Videos with transcript and segment list (the export format is one JSON document per video)."""
    seg = TD.conversation_segments(spark, sf)
    segs = seg.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start_ms", "end_ms")))
                                       .alias("segments"))
    return (TD.conversation_videos(spark, sf).join(CH.video_transcripts(seg), "video_id").join(segs, "video_id")
            .withColumn("extraction_type", F.lit("subtitles")))


@register("export_scripts_json", EXPORT_SQL)
def q_export_scripts_json(spark: SparkSession, sf: str) -> DataFrame:
    """Export all video scripts as JSON lines under the entity's names and read the export back."""
    path = scratch_path(spark, "export")
    ST.export_videos(build_videos(spark, sf), path)
    back = spark.read.schema(ST.VIDEO_EXPORT).json(path)
    line = lambda s: F.concat_ws("|", s["Text"], s["Start"], s["End"])
    return back.select(F.col("VideoId").alias("video_id"), F.col("Title").alias("title"),
                       F.col("VideoUrl").alias("video_url"), F.col("Transcript").alias("transcript"),
                       F.col("ExtractionType").alias("extraction_type"),
                       F.array_join(F.transform("Segments", line), ";").alias("segments"))
