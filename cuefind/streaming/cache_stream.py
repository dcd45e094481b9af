"""The query cache as streams: a roll-up of a request log, and cached search over incoming requests.

Both write the bucketed ``query_cache`` table. A micro-batch commits its epoch as a mark of the table version it
makes, in the same commit as its rows. A batch that is run again after a failure finds its epoch there and
changes nothing, so counts are exact whatever fails in between.

``run_rollup_stream`` keeps one row of state per query in Spark's state store (first and last request, count, first
answer) and replaces a changed query's row in the table: late rows count like all others, and a restart goes on from the
checkpoint. A query's state is never dropped, since a request may always come later; the watermark
only reports how far the log has come.

``run_search_stream`` answers requests batch by batch with ``cached_search``. The answers of an epoch are a
folder, written before the table is changed: a repeated epoch either writes the same folder again or is known already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuefind.operators import cache as CA
from cuefind.session import reliable_checkpoint
from cuefind.sources import store as ST

#: How far the roll-up's event time runs behind the latest request seen.
WATERMARK = "1 hour"


def mark_of(stream: str) -> str:
    return f"epoch:{stream}"


def is_committed(spark: SparkSession, tables: str, stream: str, epoch: int) -> bool:
    """Is this epoch's change in the table already?"""
    return int(ST.read_version(spark, tables, "query_cache").marks.get(mark_of(stream), -1)) >= epoch


def _available_now(frames: DataFrame, checkpoint: str, each, mode: str = "append") -> None:
    query = (frames.writeStream.outputMode(mode).foreachBatch(each)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def store_rollup(spark: SparkSession, tables: str, stream: str, changed: DataFrame, epoch: int) -> None:
    """Replace the table rows of the queries that a batch changed."""
    if is_committed(spark, tables, stream, epoch):
        return
    changed = reliable_checkpoint(changed)
    columns = [f.name for f in ST.QUERY_CACHE.fields]

    def merge(old: DataFrame) -> DataFrame:
        return old.join(changed.select("normalized_query"), "normalized_query", "left_anti").unionByName(changed.select(*columns))

    ST.upsert_table(spark, tables, "query_cache", changed, merge, marks={mark_of(stream): str(epoch)})


def run_rollup_stream(spark: SparkSession, log_dir: str, schema: StructType, tables: str, checkpoint: str, *,
                      stream: str = "rollup", files_per_batch: int = 1, watermark: str = WATERMARK) -> None:
    """Roll up every log file present now (event_id, ts, query, chunk_id) into ``query_cache`` and stop."""
    log = CA.with_normalized_query(_files(spark, log_dir, schema, files_per_batch))
    log = log.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    _available_now(CA.cache_rollup(log), checkpoint, lambda df, epoch: store_rollup(spark, tables, stream, df, epoch), "update")


def answer_epoch(spark: SparkSession, requests: DataFrame, epoch: int, tables: str, answers: str, chunks: DataFrame,
                 videos: DataFrame, stream: str, index: DataFrame | None = None) -> None:
    """One batch of requests, exactly once."""
    if is_committed(spark, tables, stream, epoch):
        return
    folder = f"{answers.rstrip('/')}/epoch={epoch}"
    CA.cached_search(spark, tables, requests, chunks, videos, marks={mark_of(stream): str(epoch)}, index=index,
                     before_commit=lambda shaped: shaped.write.mode("overwrite").parquet(folder))


def run_search_stream(spark: SparkSession, request_dir: str, schema: StructType, tables: str, answers: str, checkpoint: str,
                      chunks: DataFrame, videos: DataFrame, *, stream: str = "search", files_per_batch: int = 1000,
                      index: DataFrame | None = None) -> None:
    """Answer every request file present now (event_id, ts, query, embedding) and stop. With the chunks' kept
    trigram ``index`` a batch reads no text but its answers'."""
    frames = _files(spark, request_dir, schema, files_per_batch)
    _available_now(frames, checkpoint, lambda df, epoch: answer_epoch(spark, df, epoch, tables, answers, chunks, videos, stream, index))
