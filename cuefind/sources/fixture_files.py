"""Write listing and subtitle files derived from the conversations table (Spark jobs).

These are the file inputs of the ingest path, built from the given tables so that their
size grows with them. Files go under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cuefind.functions.text import is_blank
from cuefind.session import scratch_path
from cuefind.sources import testdata as TD
from cuefind.sources.store import timespan_text

FILE_TASKS = 4              # tasks a core that write files
# ---- fixed values of the file fixtures ----------------------------------------------------
CUE_SPAN_MS = 400_000       # turn k's cue covers [k * 400 s, (k + 1) * 400 s - 1 s]
CUE_GAP_MS = 1_000
REPEAT_TEXT = "repeated timing line"
SETTINGS_SUFFIX = " align:start"
# -------------------------------------------------------------------------------------------


def write_listing(spark: SparkSession, sf_dir: str, title: str = "conv ", which=None) -> str:
    """Lines 'video_id<TAB>conv N' for every conversation (or those that ``which`` holds for), plus one
    empty line and one line without a tab; written as plain text part files."""
    path = scratch_path(spark, "listing")
    conv = TD.read(spark, sf_dir, "conversations").select("conv_id").distinct()
    conv = conv if which is None else conv.where(which)
    lines = conv.select(F.concat(TD.video_id_of("conv_id"), F.lit("\t"),
                                 F.lit(title), F.col("conv_id").cast("string")).alias("value"))
    extra = spark.range(1).select(F.explode(F.array(F.lit(""), F.lit("no tab on this line"))).alias("value"))
    lines.unionByName(extra).write.mode("overwrite").text(path)
    return path


def subtitle_file_rows(spark: SparkSession, sf_dir: str):
    """(video_id, value): one WebVTT text per conversation. Each turn is a cue with its
    non-blank lines; each file also repeats the first timing line (its text must resolve
    to the first cue's) and has a cue with settings (must be dropped)."""
    conv = TD.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    start = F.col("turn") * CUE_SPAN_MS
    end = start + CUE_SPAN_MS - CUE_GAP_MS
    timing = F.concat(timespan_text(start), F.lit(" --> "), timespan_text(end))
    body = F.filter(F.split(F.col("text"), "\n"), lambda ln: ~is_blank(ln))
    cue = F.array_join(F.concat(F.array(timing), body, F.array(F.lit(""))), "\n")
    cues = conv.select(TD.video_id_of("conv_id").alias("video_id"), "turn", timing.alias("timing"),
                       cue.alias("cue"))
    per_video = cues.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "cue", "timing"))).alias("cues"))
    first_timing = F.element_at(F.col("cues"), 1)["timing"]
    content = F.concat_ws(
        "\n", F.lit("WEBVTT"), F.lit(""),
        F.array_join(F.transform(F.col("cues"), lambda c: c["cue"]), "\n"),
        first_timing, F.lit(REPEAT_TEXT), F.lit(""),
        F.concat(first_timing, F.lit(SETTINGS_SUFFIX)), F.lit("text of a cue with settings"), F.lit(""))
    return per_video.select("video_id", content.alias("value"))


def write_subtitles(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """One file per video under ``video_id=<id>/``. Files cost more than their bytes, so the videos are dealt to all cores."""
    path = path or scratch_path(spark, "subtitles")
    tasks = FILE_TASKS * spark.sparkContext.defaultParallelism
    subtitle_file_rows(spark, sf_dir).repartition(tasks, F.xxhash64("video_id")).write.mode("overwrite").partitionBy("video_id").text(path)
    return path
