"""Playlist listings: text files of ``id<TAB>title`` lines, one file per playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.functions.text import clr_trim, watch_url
from cuefind.sources.lines import number_lines, scan_lines

LISTING_SCHEMA = "value string"
LINE_END = "\n"  # fixed value


def parse_listing_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Split each line on the first tab; drop empty lines and lines without a tab; trim
    both parts; build the watch URL."""
    parts = F.split(F.col(line_col), "\t", 2)
    ok = lines.where((F.col(line_col) != "") & (F.size(parts) == 2))
    vid = clr_trim(F.element_at(parts, 1))
    return ok.select(
        *[c for c in lines.columns if c != line_col],
        vid.alias("video_id"),
        clr_trim(F.element_at(parts, 2)).alias("title"),
        watch_url(vid).alias("video_url"),
    )


def read_listings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All playlists in one plan (the sequential per-playlist loop as one scan): columns
    playlist (position in ``paths``), source (file), line_no, video_id, title, video_url.

    The number of playlists is small and fixed by the caller, so one read per playlist path is
    unioned; a large file is read by many tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = None
    for i, p in enumerate(paths):
        own = scan_lines(spark, p, LINE_END).select(F.lit(i).alias("playlist"), "source", "start", "value")
        lines = own if lines is None else lines.unionByName(own)
    return listing_lines(lines)


def listing_lines(lines: DataFrame) -> DataFrame:
    """Scanned lines (playlist, source, start, value) -> parsed lines with their number in the file; only ``\\n`` ends
    a line (a ``\\r`` before it is trimmed with the title)."""
    return parse_listing_lines(number_lines(lines).select("playlist", "source", "line_no", "value"))


def first_listing_per_video(listing: DataFrame) -> DataFrame:
    """One row per video id: the first occurrence by (playlist, file, line), as the
    sequential per-playlist loop with only-missing ingest keeps it. Partial aggregate, so a
    video listed in every playlist is combined map-side."""
    order = F.struct("playlist", "source", "line_no")
    return listing.groupBy("video_id").agg(
        F.min_by(F.struct("title", "video_url", "playlist", "source", "line_no"), order).alias("r")
    ).select("video_id", "r.*")
