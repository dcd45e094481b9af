"""Table store for videos, chunks and the query cache (parquet), and the JSON codecs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuefind.functions.text import parse_timespan_ms
from cuefind.session import reliable_checkpoint

VIDEOS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("video_url", T.StringType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("extraction_type", T.StringType()),
])

# Segments live in their own table keyed by (video_id, pos): a long video is many rows,
# never one giant array built by one task. Arrays exist only in the per-video JSON export.
SEGMENTS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
])

# ---- fixed values of the JSON export: the entity's field names and enum numbers
VIDEO_EXPORT = T.StructType([
    T.StructField("VideoUrl", T.StringType()),
    T.StructField("VideoId", T.StringType()),
    T.StructField("Title", T.StringType()),
    T.StructField("Transcript", T.StringType()),
    T.StructField("ExtractionType", T.IntegerType()),
    T.StructField("Segments", T.ArrayType(T.StructType([
        T.StructField("Text", T.StringType()), T.StructField("Start", T.StringType()), T.StructField("End", T.StringType())]))),
])
EXTRACTION_TYPES = {"subtitles": 0, "stt": 1}

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("threshold", T.IntegerType()),
    T.StructField("pos", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("normalized_text", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("end_pos", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUERY_CACHE = T.StructType([
    T.StructField("normalized_query", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_accessed_at", T.TimestampNTZType()),
    T.StructField("access_count", T.LongType()),
])

CHUNK_VECTORS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

SCHEMAS = {"videos": VIDEOS, "segments": SEGMENTS, "chunks": CHUNKS, "query_cache": QUERY_CACHE,
           "chunk_vectors": CHUNK_VECTORS}


#: Tables whose rows are changed by key: they lie in buckets by a hash of it.
KEYS = {"videos": "video_id", "segments": "video_id", "chunks": "video_id", "query_cache": "normalized_query"}
#: Buckets of a new table (recorded with it). An upsert rewrites only the buckets its keys fall into.
BUCKETS = 32
#: Attempts of a change that loses the race against other writers.
ATTEMPTS = 5


# ---- tables: data folders plus numbered manifests ------------------------------------------
#
# <root>/<name>/part-<id>/[bucket=<b>/]   Parquet folders, never changed once a manifest names them
# <root>/<name>/_manifest-<n>             version n: its folders and marks, one per line, ended by "end"
#
# A writer writes its folders first and the next manifest last (created, never overwritten). A change
# is made to the version that was read: if another writer was faster, that number is taken, nothing is
# committed, and StaleTable tells the caller to read again. A job that stops in between leaves the
# last version as it is; a reader takes the newest complete manifest and fails if a folder it names is gone.

_END = "end"


class StaleTable(RuntimeError):
    """Another writer committed a version after the one this change was made to."""


@dataclass
class Version:
    """A table as it was read: number 0 before it exists. ``marks`` are kept from version to version."""

    number: int = 0
    folders: list[str] = field(default_factory=list)
    buckets: int = BUCKETS
    marks: dict[str, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _read_text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def read_version(spark: SparkSession, root: str, name: str) -> Version:
    """The newest complete version of a table."""
    fs, path = _fs(spark, f"{root.rstrip('/')}/{name}")
    if not fs.exists(path):
        return Version()
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("_manifest-")),
                   key=lambda p: p.getName(), reverse=True)
    for file in files:
        lines = _read_text(fs, file).split("\n")
        if lines[-1] == _END:
            out = Version(int(file.getName().rsplit("-", 1)[1]))
            for line in lines[:-1]:
                kind, _, value = line.partition(" ")
                if kind == "buckets":
                    out.buckets = int(value)
                elif kind == "mark":
                    out.marks.update([value.split(" ", 1)])
                else:
                    out.folders.append(line)
            return out
    return Version()


def table_version(spark: SparkSession, root: str, name: str) -> tuple[int, list[str]]:
    """(version, folders) of a table; version 0 before it exists."""
    version = read_version(spark, root, name)
    return version.number, version.folders


def _commit(spark: SparkSession, root: str, name: str, was: Version, folders: list[str], marks: dict[str, str] | None = None) -> None:
    """The version after ``was``; StaleTable if there is one already."""
    number = was.number + 1
    fs, path = _fs(spark, f"{root.rstrip('/')}/{name}/_manifest-{number:012d}")
    lines = [f"buckets {was.buckets}", *(f"mark {k} {v}" for k, v in (was.marks | (marks or {})).items()), *folders, _END]
    try:
        stream = fs.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(path):
            raise StaleTable(f"{name}: version {number} was committed by another writer") from e
        raise
    try:
        stream.write(bytearray("\n".join(lines).encode("utf-8")))
    finally:
        stream.close()


def with_retries(change: Callable[[], object], attempts: int = ATTEMPTS):
    """Run a change that reads the newest version itself, again if it was stale."""
    for attempt in range(attempts):
        try:
            return change()
        except StaleTable:
            if attempt == attempts - 1:
                raise


def bucket_of(name: str, buckets: int):
    return F.pmod(F.xxhash64(KEYS[name]), F.lit(buckets)).cast("int")


def _write_part(df: DataFrame, root: str, name: str, buckets: int) -> list[str]:
    """Write rows to a new folder, in buckets if the table has a key; returns what a manifest names. A bucket
    is gathered for few files; AQE splits one that a hot key fills."""
    part, base = f"part-{uuid.uuid4().hex}", f"{root.rstrip('/')}/{name}"
    rows = df.select(*(f.name for f in SCHEMAS[name].fields))
    if name not in KEYS:
        rows.write.parquet(f"{base}/{part}")
        return [part]
    bucketed = rows.withColumn("bucket", bucket_of(name, buckets))
    bucketed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{base}/{part}")
    fs, path = _fs(df.sparkSession, f"{base}/{part}")
    found = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("bucket="))
    return [f"{part}/{b}" for b in found]


def _read_folders(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*(f"{root.rstrip('/')}/{name}/{f}" for f in folders))


def read_table(spark: SparkSession, root: str, name: str, version: Version | None = None) -> DataFrame:
    """The table's newest (or a given) version; an empty one before the first write (create if absent)."""
    return _read_folders(spark, root, name, (version or read_version(spark, root, name)).folders)


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Add rows: more folders in the next version. Written once; the commit is repeated if another was faster."""
    spark = df.sparkSession
    parts = _write_part(df, root, name, read_version(spark, root, name).buckets)

    append_folders(spark, root, name, parts)


def append_folders(spark: SparkSession, root: str, name: str, folders: list[str]) -> None:
    """Add folders that were written under the table's own."""
    def commit():
        now = read_version(spark, root, name)
        _commit(spark, root, name, now, [*now.folders, *(f for f in folders if f not in set(now.folders))])

    with_retries(commit)


def replace_table(df: DataFrame, root: str, name: str, version: Version | None = None, buckets: int | None = None) -> None:
    """The rows of ``df`` become the next version (``df`` may read the present one). ``version``: the one its
    rows were read from; if it is no longer the newest, nothing is committed and StaleTable is raised."""
    spark = df.sparkSession
    version = version or read_version(spark, root, name)
    if buckets:
        version = Version(version.number, version.folders, buckets, version.marks)
    _commit(spark, root, name, version, _write_part(df, root, name, version.buckets))


def upsert_table(spark: SparkSession, root: str, name: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame],
                 version: Version | None = None, marks: dict[str, str] | None = None) -> None:
    """Change the rows of some keys: ``merge`` gets the present rows of the buckets that ``keys`` fall into and
    returns these buckets' new rows. The other buckets' folders stay as they are, unread. With ``version``
    (the one the change was computed from) a faster writer means StaleTable; without, the merge is repeated on
    the newest version."""
    keys = reliable_checkpoint(keys.select(KEYS[name]).distinct())

    def change():
        was = version or read_version(spark, root, name)
        touched = {f"bucket={r[0]}" for r in keys.select(bucket_of(name, was.buckets)).distinct().collect()}    # at most the buckets
        mine = [f for f in was.folders if f.rpartition("/")[2] in touched]
        others = [f for f in was.folders if f not in set(mine)]
        parts = _write_part(merge(_read_folders(spark, root, name, mine)), root, name, was.buckets) if touched else []
        _commit(spark, root, name, was, [*others, *parts], marks)

    with_retries(change, 1 if version else ATTEMPTS)


def drop_old_versions(spark: SparkSession, root: str, name: str) -> None:
    """Delete the folders and manifests that the present version does not need. For times without readers
    of older versions and without running writers."""
    version, folders = table_version(spark, root, name)
    fs, path = _fs(spark, f"{root.rstrip('/')}/{name}")
    needed = {f.partition("/")[0] for f in folders}
    for file in fs.listStatus(path) if version else []:
        own = file.getPath().getName()
        if own in needed:
            for part in fs.listStatus(file.getPath()):
                bucket = part.getPath().getName()
                if bucket.startswith("bucket=") and f"{own}/{bucket}" not in folders:
                    fs.delete(part.getPath(), True)
        elif own != f"_manifest-{version:012d}":
            fs.delete(file.getPath(), True)


# ---- segment JSON codec: [{"Text": ..., "Start": "hh:mm:ss[.fffffff]", "End": ...}] --------

def timespan_text(ms) -> F.Column:
    """ms -> constant TimeSpan text '[-][d.]hh:mm:ss[.fffffff]' (fraction only when non-zero)."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    size = F.abs(ms)
    d = F.floor(size / 86400000)
    h = F.floor(size / 3600000) % 24
    m = F.floor(size / 60000) % 60
    s = F.floor(size / 1000) % 60
    frac = size % 1000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    core = F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s))
    with_frac = F.when(frac == 0, core).otherwise(
        F.concat(core, F.lit("."), F.lpad((frac * 10000).cast("string"), 7, "0")))
    whole = F.when(d > 0, F.concat(d.cast("string"), F.lit("."), with_frac)).otherwise(with_frac)
    return F.when(ms < 0, F.concat(F.lit("-"), whole)).otherwise(whole)


def segment_entities(segments: F.Column) -> F.Column:
    """array<struct<text,start_ms,end_ms>> under the stored field names."""
    return F.transform(segments, lambda s: F.struct(
        s["text"].alias("Text"), timespan_text(s["start_ms"]).alias("Start"), timespan_text(s["end_ms"]).alias("End")))


def segments_to_json(segments: F.Column) -> F.Column:
    return F.to_json(segment_entities(segments))


def export_videos(videos: DataFrame, path: str) -> None:
    """Videos (with ``segments`` arrays) as one JSON document a line."""
    number = F.coalesce(*(F.when(F.col("extraction_type") == k, v) for k, v in EXTRACTION_TYPES.items()))
    videos.select(F.col("video_url").alias("VideoUrl"), F.col("video_id").alias("VideoId"), F.col("title").alias("Title"),
                  F.col("transcript").alias("Transcript"), number.alias("ExtractionType"),
                  segment_entities(F.col("segments")).alias("Segments")).write.json(path)


def segments_from_json(js: F.Column) -> F.Column:
    parsed = F.from_json(js, "array<struct<Text:string,Start:string,End:string>>")
    return F.transform(parsed, lambda s: F.struct(
        s["Text"].alias("text"), parse_timespan_ms(s["Start"]).alias("start_ms"),
        parse_timespan_ms(s["End"]).alias("end_ms")))
