"""WebVTT-style subtitle files -> timed segments, with window functions only.

A line is a cue when it contains ' --> ' and both the part before and the part after the
first separator parse as a time span. Its text is the following lines up to the first
blank line, joined by one space. With ``first_match`` (the reference behaviour) the text
is looked up after the *first* line identical to the cue line, so a repeated timing line
takes the first cue's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuefind.functions.text import is_blank, parse_timespan_ms
from cuefind.sources.lines import number_lines, scan_lines

CUE_SEPARATOR = " --> "  # fixed value


def read_subtitle_lines(spark: SparkSession, path: str, id_col: str = "video_id") -> DataFrame:
    """The lines of all files, by split: a large file is read by many tasks. ``video_id`` comes from a
    ``video_id=...`` folder."""
    return scan_lines(spark, path, columns=f"{id_col} string")


def subtitle_videos(spark: SparkSession, path: str, id_col: str = "video_id") -> DataFrame:
    """The videos that have a file (Spark lists none of zero bytes); no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", f"/{id_col}=([^/]+)/", 1).alias(id_col)).distinct()


def parse_subtitle_lines(lines: DataFrame, id_col: str = "video_id", first_match: bool = True) -> DataFrame:
    """Scanned lines -> segments(id_col, pos, text, start_ms, end_ms). Line numbers and blocks (how many blank
    lines so far) are carried from split to split, so no task needs a whole file."""
    numbered = number_lines(lines, "pos", {"blk": is_blank(F.col("value"))})
    return _cues(numbered.withColumnRenamed("value", "line"), [id_col, "source"], first_match).drop("source")


def parse_subtitles(files: DataFrame, id_col: str = "video_id", first_match: bool = True) -> DataFrame:
    """The same for texts that are rows already: files(id_col, value)."""
    lines = files.select(id_col, F.posexplode(F.split(F.col("value"), "\r\n|\r|\n")).alias("pos", "line"))
    w_file = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _cues(lines.withColumn("blk", F.sum(is_blank(F.col("line")).cast("int")).over(w_file)), [id_col], first_match)


def _cues(lines: DataFrame, key: list[str], first_match: bool) -> DataFrame:
    """Lines are gathered once per block (up to the next blank line); a cue takes the rest of its block."""
    blocks = lines.groupBy(*key, "blk").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    blocks = blocks.select(*key, "blk", F.col("rows")[0]["pos"].alias("head"), F.col("rows.line").alias("body"))
    parts = F.split(F.col("line"), CUE_SEPARATOR)
    cues = lines.where(F.col("line").contains(CUE_SEPARATOR)).select(
        *key, "pos", "blk", "line", parse_timespan_ms(F.element_at(parts, 1)).alias("start_ms"),
        parse_timespan_ms(F.element_at(parts, 2)).alias("end_ms")).where("start_ms is not null and end_ms is not null")
    place = F.struct(F.col("pos"), F.col("blk"))
    if first_match:
        place = F.min(place).over(Window.partitionBy(*key, "line"))
    cues = cues.withColumn("at", place).select(*key, "pos", F.col("at.pos").alias("from"), F.col("at.blk").alias("blk"),
                                               "start_ms", "end_ms")
    rest = F.slice("body", (F.col("from") - F.col("head") + 2).cast("int"), F.greatest(F.size("body"), F.lit(1)))
    return cues.join(blocks, [*key, "blk"]).select(
        *key, F.col("pos").cast("long").alias("pos"), F.array_join(rest, " ").alias("text"), "start_ms", "end_ms")
