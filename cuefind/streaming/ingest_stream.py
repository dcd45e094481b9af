"""Incremental ingest as Structured Streaming over a folder of listing files.

Each micro-batch (``foreachBatch``) parses the new listing lines, keeps only videos not
stored yet (anti join against the videos table), builds their scripts, appends them, and
then chunks the batch's videos that have no chunks yet. Both steps are anti joins against
the tables themselves, so a replayed batch after an executor or driver failure writes
nothing twice; the checkpoint records which files were consumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.operators import chunking as CH
from cuefind.operators import ingest as IN
from cuefind.operators.common import rows_with_keys
from cuefind.session import reliable_checkpoint, written
from cuefind.sources import lines as LN
from cuefind.sources import listing as LI
from cuefind.sources import store as ST

ScriptSource = Callable[[DataFrame], DataFrame]
"""Given wanted (video_id), returns choose_scripts rows for them."""


def _process_batch(spark: SparkSession, batch: DataFrame, tables: str, scripts_for: ScriptSource) -> None:
    listing = reliable_checkpoint(LI.first_listing_per_video(LI.listing_lines(batch))
                                  .select("video_id", "title", "video_url"))
    missing = IN.ingest_missing(listing, ST.read_table(spark, tables, "videos"))
    choice = written(scripts_for(missing.select("video_id")))
    new_rows = reliable_checkpoint(missing.join(IN.scripts_from_segments(choice), "video_id"))
    # segments first, then the video row: a replay after a failure in between finds the
    # video still missing and its segments already present (skipped by the anti join)
    new_segs = IN.not_yet_stored(IN.script_segments(choice).join(new_rows.select("video_id"), "video_id", "left_semi"),
                                 rows_with_keys(ST.read_table(spark, tables, "segments"), listing, "video_id"))
    ST.append_table(new_segs, tables, "segments")
    ST.append_table(new_rows, tables, "videos")
    chunk_videos(spark, tables, listing)


def chunk_videos(spark: SparkSession, tables: str, videos: DataFrame) -> None:
    """Chunk those of ``videos`` that are stored and have no chunks; the tables are cut down to them
    first, so the work follows the batch. With the whole videos table: the recovery pass."""
    stored = rows_with_keys(ST.read_table(spark, tables, "videos"), videos, "video_id").select("video_id")
    todo = CH.videos_unchunked(stored, rows_with_keys(ST.read_table(spark, tables, "chunks"), videos, "video_id"))
    segments = rows_with_keys(ST.read_table(spark, tables, "segments"), todo, "video_id")
    fresh = CH.chunk_segments(segments).withColumn("embedding", F.lit(None).cast("array<float>"))
    ST.append_table(fresh, tables, "chunks")


def run_ingest_stream(spark: SparkSession, listing_dir: str, tables: str, checkpoint: str,
                      scripts_for: ScriptSource, files_per_batch: int = 1) -> None:
    """Consume every listing file present now (availableNow) and stop. A file is read by splits, and its lines
    are numbered in each batch, so the first line of a repeated video wins here as in the batch job."""
    files = LN.with_place(spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
                          .option("lineSep", LI.LINE_END).load(listing_dir)).select(F.lit(0).alias("playlist"), "source", "start", "value")
    q = (files.writeStream
         .foreachBatch(lambda df, epoch: _process_batch(spark, df, tables, scripts_for))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
