"""The batch job of the reference's fetcher, with its three stage flags.

extract (default on): listing -> only-missing (or all, then upsert) -> scripts -> videos
chunk   (default off): chunk every stored video that has no chunks -> chunks
embed   (default off): vectors for chunks without one -> chunk_vectors (append, resumable)

Each stage reads the tables it writes through anti joins, so re-running a stage after a
failure repeats nothing that was already written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.operators import chunking as CH
from cuefind.operators import embed as EM
from cuefind.operators import ingest as IN
from cuefind.operators.common import rows_with_keys
from cuefind.session import reliable_checkpoint, written
from cuefind.sources import listing as LI
from cuefind.sources import store as ST
from cuefind.streaming.ingest_stream import chunk_videos

def extract_stage(spark: SparkSession, listing_paths, tables: str, scripts_for, only_missing: bool = True):
    """Returns the one-row ingest counts of this run."""
    listing = reliable_checkpoint(LI.first_listing_per_video(LI.read_listings(spark, listing_paths)).select(
        "video_id", "title", "video_url"))
    stored = ST.read_table(spark, tables, "videos")         # a version: later writes do not change it
    missing = IN.ingest_missing(listing, stored)
    wanted = missing if only_missing else listing
    choice = written(scripts_for(wanted.select("video_id")))
    scripts = IN.scripts_from_segments(choice)
    if only_missing:
        new_rows = reliable_checkpoint(wanted.join(scripts, "video_id"))
        segs = ST.read_table(spark, tables, "segments")
        new_segs = IN.not_yet_stored(
            IN.script_segments(choice).join(new_rows.select("video_id"), "video_id", "left_semi"), segs)
        # segments first, then videos: a rerun after a failure in between writes no duplicate
        ST.append_table(new_segs, tables, "segments")
        ST.append_table(new_rows, tables, "videos")
    else:
        upsert_scripts(spark, tables, listing, choice)
    return IN.ingest_stats(listing, stored, choice).collect()[0].asDict()


def upsert_scripts(spark: SparkSession, tables: str, listing: DataFrame, choice: DataFrame) -> None:
    """Re-extracted videos: their segments replaced, then their rows updated or inserted. Only the buckets these
    videos lie in are read and rewritten."""
    scripts = reliable_checkpoint(IN.scripts_from_segments(choice))
    ST.upsert_table(spark, tables, "segments", scripts, lambda old: IN.segments_upsert(old, IN.script_segments(choice), scripts))
    ST.upsert_table(spark, tables, "videos", scripts, lambda old: IN.video_upsert(old, listing, scripts))


def chunk_stage(spark: SparkSession, tables: str) -> None:
    """Chunk every stored video without chunks."""
    chunk_videos(spark, tables, ST.read_table(spark, tables, "videos"))


def rechunk(spark: SparkSession, tables: str, videos: DataFrame) -> None:
    """Chunk ``videos`` (video_id) anew: their chunks are replaced, all others stay."""
    segments = rows_with_keys(ST.read_table(spark, tables, "segments"), videos, "video_id")
    fresh = CH.chunk_segments(segments).withColumn("embedding", F.lit(None).cast("array<float>"))
    fresh = reliable_checkpoint(fresh.select(*(f.name for f in ST.CHUNKS.fields)))
    ST.upsert_table(spark, tables, "chunks", fresh, lambda old: CH.replace_chunks(old, fresh))


#: Pending chunks of one bucket of the embedding stage, unless that makes more than ``EMBED_BUCKETS``.
EMBED_COMMIT_ROWS = 1_000_000
EMBED_BUCKETS = 16
#: Commits of a run at most: each names all folders so far.
EMBED_COMMITS = 64


def embed_stage(spark: SparkSession, tables: str, provider: EM.Provider, commit_rows: int = EMBED_COMMIT_ROWS,
                pause_s: float = EM.PAUSE_S) -> None:
    """Vectors for pending chunks, bucket by bucket. The pending rows are found by one scan and written once, by
    bucket; each bucket then reads its own folder, and what it has written is kept. A run after a failure
    goes on with the buckets that are not finished, without a scan, and then looks for new pending chunks."""
    work = f"{tables.rstrip('/')}/_embed"
    for run in EM.open_runs(spark, work):
        _embed_run(spark, tables, run, provider, pause_s)
    done = ST.read_table(spark, tables, "chunk_vectors")
    run = EM.plan_backfill(EM.pending(ST.read_table(spark, tables, "chunks"), done), work, commit_rows, EMBED_BUCKETS)
    if run:
        _embed_run(spark, tables, run, provider, pause_s)


def _embed_run(spark: SparkSession, tables: str, run: str, provider: EM.Provider, pause_s: float) -> None:
    table = f"{tables.rstrip('/')}/chunk_vectors"
    buckets = EM.run_buckets(spark, run)
    finished = [b for b in buckets if EM.is_complete(spark, f"{table}/{EM.bucket_output(run, b)}")]
    step = -(-len(buckets) // EMBED_COMMITS)
    ready = [EM.bucket_output(run, b) for b in finished]
    try:
        for b in buckets:
            if b in finished:
                continue
            EM.embed_bucket(spark, run, b, f"{table}/{EM.bucket_output(run, b)}", provider, pause_s)
            ready.append(EM.bucket_output(run, b))
            if len(ready) >= step:
                ST.append_folders(spark, tables, "chunk_vectors", ready)
                ready = []
    finally:
        if ready:
            ST.append_folders(spark, tables, "chunk_vectors", ready)
    EM.close_run(spark, run)


def chunks_with_vectors(spark: SparkSession, tables: str) -> DataFrame:
    return EM.apply_embeddings(ST.read_table(spark, tables, "chunks"), ST.read_table(spark, tables, "chunk_vectors"))


def run_fetch_job(spark: SparkSession, listing_paths, tables: str, scripts_for, *, extract: bool = True,
                  chunk: bool = False, embed: bool = False, only_missing: bool = True,
                  provider: EM.Provider | None = None, pause_s: float = EM.PAUSE_S) -> dict | None:
    stats = None
    if extract:
        stats = extract_stage(spark, listing_paths, tables, scripts_for, only_missing)
    if chunk:
        chunk_stage(spark, tables)
    if embed:
        embed_stage(spark, tables, provider or EM.hashed_trigram_provider(), pause_s=pause_s)
    return stats
