"""Readers for the parquet tables and the logical inputs derived from them.

Every logical input (videos, segments, chunk corpus, queries, query log) is a Spark
projection/join over the given tables, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuefind.functions.text import normalize_text, watch_url
from cuefind.operators.common import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# ---- fixed values of the fixture mapping (FIXTURES.md) ----------------------------------
VIDEO_ID_WIDTH = 11          # video ids are 11 characters
CHUNK_ID_WIDTH = 12          # zero-padded numeric chunk ids sort like numbers
MS_PER_WORD = 400            # each word segment lasts 400 ms
TURNS_PER_BLOCK = 4096       # turns whose words are summed in one window group
# -----------------------------------------------------------------------------------------


# tables whose rows carry per-row CPU work (text normalization, trigram and vector kernels)
_SPREAD = {"documents", "conversations", "events", "embeddings", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in _SPREAD else df


def padded(number, width: int) -> F.Column:
    """The number with leading zeros up to ``width`` digits; longer numbers stay whole."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def video_id_of(conv_id) -> F.Column:
    return padded(conv_id, VIDEO_ID_WIDTH)


def conversation_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video per conversation: (video_id, title, video_url)."""
    conv = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    vid = video_id_of("conv_id")
    return conv.select(
        vid.alias("video_id"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("title"),
        watch_url(vid).alias("video_url"),
    )


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed word segments: words of each turn split on [ \\n]+ (empty words kept). ``pos`` counts the
    words of the earlier turns and those before it in its own: sums per block of turns first, so
    a long conversation is many window groups."""
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.col("text"), "[ \n]+").alias("words"))
    turns = conv.select("conv_id", "turn", F.size("words").cast("long").alias("n"),
                        F.floor(F.col("turn") / TURNS_PER_BLOCK).cast("long").alias("block"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (turns.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
              .select("conv_id", "block", F.coalesce(F.sum("n").over(before.partitionBy("conv_id").orderBy("block")), F.lit(0))
                      .alias("base")))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("conv_id", "block").orderBy("turn")), F.lit(0))
    starts = (turns.withColumn("inside", inside).join(blocks, ["conv_id", "block"])
              .select("conv_id", "turn", (F.col("base") + F.col("inside")).alias("start")))
    seg = conv.join(starts, ["conv_id", "turn"]).select(
        video_id_of("conv_id").alias("video_id"), "start", F.posexplode("words").alias("idx", "text"))
    pos = F.col("start") + F.col("idx")
    return seg.select(
        "video_id",
        pos.alias("pos"),
        "text",
        (pos * MS_PER_WORD).cast("long").alias("start_ms"),
        (pos * MS_PER_WORD + MS_PER_WORD).cast("long").alias("end_ms"),
    )


def chunk_id_of(num) -> F.Column:
    return padded(num, CHUNK_ID_WIDTH)


def document_video_id() -> F.Column:
    return F.concat(F.lit("doc"), padded("doc_id", VIDEO_ID_WIDTH - 3))


def document_corpus(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """All documents as ready-made chunks (whole text), with their vectors on doc_id = vec_id, null
    where there is none.

    Columns: chunk_id, video_id, text, normalized_text, start_ms, end_ms[, embedding]."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    if with_vectors:
        emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        docs = docs.join(emb, "doc_id", "left")
    cols = [
        chunk_id_of(F.col("doc_id")).alias("chunk_id"),
        document_video_id().alias("video_id"),
        F.col("text"),
        normalize_text(F.col("text")).alias("normalized_text"),
        F.lit(0).cast("long").alias("start_ms"),
        F.lit(0).cast("long").alias("end_ms"),
    ]
    if with_vectors:
        cols.append(F.col("embedding"))
    return docs.select(*cols)


def document_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    vid = document_video_id()
    return docs.select(
        vid.alias("video_id"),
        F.concat(F.col("source"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        watch_url(vid).alias("video_url"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """Whole benchmark passages as queries; query k carries vector k (left join)."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    if with_vectors:
        emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        q = q.join(emb, "query_id", "left")
    return q


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests derived from events: (event_id, ts, user_id, query, chunk_id).

    query alternates case by event parity so normalization has to merge variants; the
    logged answer chunk comes from the event value."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit("!"))
    query = F.when(F.col("event_id") % 2 == 0, F.upper(base)).otherwise(base)
    return ev.select(
        "event_id", "ts", "user_id",
        query.alias("query"),
        chunk_id_of(F.floor(F.col("value") * 100).cast("long")).alias("chunk_id"),
    )
