"""Incremental ingest: only-missing selection, script choice, video upsert, reports.

The reference walks the listing one video at a time with a lookup per video; here each
step is one join over the whole listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefind.operators.chunking import video_transcripts


def ingest_missing(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed videos that are not stored yet (left anti join on video_id)."""
    return listing.join(stored.select("video_id"), "video_id", "left_anti")


def choose_scripts(wanted: DataFrame, subtitle_files: DataFrame, subtitle_segments: DataFrame,
                   stt_segments: DataFrame) -> DataFrame:
    """Segments per wanted video: subtitles when a subtitle file exists (even one with no
    cues), otherwise speech-to-text output; videos with neither get no script.

    Returns (video_id, extraction_type, pos, text, start_ms, end_ms) plus one marker row
    per scripted video with null pos (so a zero-segment script still counts)."""
    ids = wanted.select("video_id")
    has_sub = ids.join(subtitle_files.select("video_id").distinct(), "video_id", "left_semi")
    no_sub = ids.join(has_sub, "video_id", "left_anti")
    has_stt = no_sub.join(stt_segments.select("video_id").distinct(), "video_id", "left_semi")
    cols = ["video_id", "pos", "text", "start_ms", "end_ms"]
    sub = subtitle_segments.select(*cols).join(has_sub, "video_id", "left_semi").withColumn(
        "extraction_type", F.lit("subtitles"))
    stt = stt_segments.select(*cols).join(has_stt, "video_id", "left_semi").withColumn(
        "extraction_type", F.lit("stt"))
    markers = (has_sub.withColumn("extraction_type", F.lit("subtitles"))
               .unionByName(has_stt.withColumn("extraction_type", F.lit("stt")))
               .select("video_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"),
                       F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
                       "extraction_type"))
    return sub.unionByName(stt).unionByName(markers)


def scripts_from_segments(choice: DataFrame) -> DataFrame:
    """(video_id, extraction_type, transcript) from ``choose_scripts`` rows."""
    seg = choice.where(F.col("pos").isNotNull())
    kinds = choice.where(F.col("pos").isNull()).select("video_id", "extraction_type")
    tr = video_transcripts(seg)
    return (kinds.join(tr, "video_id", "left")
            .select("video_id", "extraction_type", F.coalesce("transcript", F.lit("")).alias("transcript")))


def script_segments(choice: DataFrame) -> DataFrame:
    """The segment rows of ``choose_scripts`` output (segments table layout)."""
    return choice.where(F.col("pos").isNotNull()).select("video_id", "pos", "text", "start_ms", "end_ms")


def video_upsert(stored: DataFrame, listing: DataFrame, scripts: DataFrame) -> DataFrame:
    """Upsert on video_id: a stored video gets the new transcript only (title and url stay;
    its segments are replaced by ``segments_upsert``); a new video is inserted with the
    listing's title and url."""
    s = stored.alias("s")
    new = listing.join(scripts, "video_id").alias("n")
    j = s.join(new, F.col("s.video_id") == F.col("n.video_id"), "full_outer")
    pick = lambda c: F.when(F.col("n.video_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
    return j.select(
        F.coalesce("s.video_id", "n.video_id").alias("video_id"),
        F.coalesce("s.title", "n.title").alias("title"),
        F.coalesce("s.video_url", "n.video_url").alias("video_url"),
        pick("transcript").alias("transcript"),
        # the stored row keeps its default extraction type, as in the reference
        F.coalesce("s.extraction_type", "n.extraction_type").alias("extraction_type"),
    )


def segments_upsert(stored_segments: DataFrame, new_segments: DataFrame, replaced: DataFrame) -> DataFrame:
    """Segments of every re-extracted video are replaced; others stay (anti join + union)."""
    keep = stored_segments.join(replaced.select("video_id").distinct(), "video_id", "left_anti")
    return keep.unionByName(new_segments.select(*keep.columns))


def not_yet_stored(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of videos that have no row in ``table`` yet: makes an append replay-safe."""
    return rows.join(table.select("video_id").distinct(), "video_id", "left_anti")


def missing_report(listing: DataFrame, stored: DataFrame, scripted: DataFrame) -> DataFrame:
    """Listed videos absent from the table after an only-missing run: not stored before, no script now."""
    there = stored.select("video_id").unionByName(scripted.select("video_id")).distinct()
    return listing.join(there, "video_id", "left_anti")


def ingest_stats(listing: DataFrame, stored: DataFrame, scripted: DataFrame) -> DataFrame:
    """One row of counts. Ids are tagged and brought together by one aggregate, so each input is read once."""
    tags = ("listed", "stored", "scripted")
    tagged = None
    for name, df in zip(tags, (listing, stored, scripted)):
        t = df.select("video_id", *(F.lit(name == x).alias(x) for x in tags))
        tagged = t if tagged is None else tagged.unionByName(t)
    ids = tagged.groupBy("video_id").agg(*(F.max(x).alias(x) for x in tags))
    new = F.col("listed") & ~F.col("stored")
    return ids.agg(F.count_if("listed").alias("listed"), F.count_if("stored").alias("stored_before"),
                   F.count_if(new).alias("to_process"), F.count_if(new & F.col("scripted")).alias("processed"),
                   F.count_if(new & ~F.col("scripted")).alias("missing_after"))
