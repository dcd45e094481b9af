"""Sharding by sampled splitters (law ``bytes``: shard sizes near equal). DataFrame functions only.

1. Every record gets a key: (hash of the text, hash of the id). Equal texts are neighbours
   in key order, and a large group of them can still be cut between its ids.
2. A key sample is drawn with a chance in proportion to the record's size (decided by a hash,
   so a lost task draws the same), and its quantiles become the range boundaries.
3. Records find their range by the boundaries that share the key's leading bits. A range of
   more than ``piece_rows`` rows is subdivided into lanes by id hash, so that no window task
   gets an unbounded range, whatever the sample missed.
4. Sizes are summed per piece, running sums inside a piece are offset by the pieces before it:
   the exact position of every record in the whole order. Shard = position * shards / total.

A record goes where its middle byte falls, so shard sizes differ from total / shards by at most
the largest record; ``slot`` counts from 0
without gaps in every shard. The sample only steers how work is divided, never the result law.

Cases: a null text has size 1 and the CRC of no bytes; a null id is an id like any other;
repeated rows are placed each; an empty table gives no rows; other columns are not looked at
(``keep`` names those to carry along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuefind.llm.common import materialise

_PREFIX_BITS = 12


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _records(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    text = _text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.xxhash64(F.col(id_col), F.lit("tie")).alias("_tie"),
        F.monotonically_increasing_id().alias("_place"),
        *([F.struct(*keep).alias("_kept")] if keep else []))


def _boundaries(records: DataFrame, total: int, ranges: int, samples: int) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted key sample (about ``samples`` keys reach the driver)."""
    chance = F.col("size") * F.lit(float(samples) / max(total, 1))
    drawn = F.pmod(F.xxhash64("_tie", "_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sorted((r["_key"], r["_tie"]) for r in
                  records.where(drawn < chance).select("_key", "_tie").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _with_range(records: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Column ``_range``: how many boundaries are at or before the key."""
    spark = records.sparkSession
    shift = 64 - _PREFIX_BITS
    by_prefix: dict[int, list[tuple[int, int]]] = {}
    for k, t in bounds:
        by_prefix.setdefault(k >> shift, []).append((k, t))
    rows, before = [], 0
    for prefix in range(-(1 << (_PREFIX_BITS - 1)), 1 << (_PREFIX_BITS - 1)):
        own = by_prefix.get(prefix, [])
        rows.append((prefix, before, own))
        before += len(own)
    schema = T.StructType([
        T.StructField("_prefix", T.LongType()), T.StructField("_before", T.IntegerType()),
        T.StructField("_cuts", T.ArrayType(T.StructType([
            T.StructField("k", T.LongType()), T.StructField("t", T.LongType())])))])
    lookup = F.broadcast(spark.createDataFrame(rows, schema))     # 2^12 rows, ``ranges`` cuts in all
    passed = F.filter("_cuts", lambda c: (c["k"] < F.col("_key"))
                      | ((c["k"] == F.col("_key")) & (c["t"] <= F.col("_tie"))))
    return (records.withColumn("_prefix", F.shiftright("_key", shift))
            .join(lookup, "_prefix")
            .withColumn("_range", F.col("_before") + F.size(passed))
            .drop("_prefix", "_before", "_cuts"))


def assign(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text",
           ranges: int = 256, samples: int = 8192, piece_rows: int = 500_000,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` (and the struct ``_kept`` of ``keep``) per record."""
    records = materialise(_records(docs, id_col, text_col, keep), "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    ranged = _with_range(records, _boundaries(records, total, ranges, samples))
    lanes = ranged.groupBy("_range").agg(F.ceil(F.count("*") / F.lit(piece_rows)).cast("int").alias("_lanes"))
    ranged = (ranged.join(F.broadcast(lanes), "_range")               # ``ranges`` rows
              .withColumn("_lane", F.pmod(F.xxhash64("_tie", "_place"), F.col("_lanes")).cast("int"))
              .drop("_lanes"))
    piece = ["_range", "_lane"]
    # few piece rows: ranges + rows / piece_rows
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (ranged.groupBy(*piece).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
              .select(*piece, F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
                      F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0")))
    order = Window.partitionBy(*piece).orderBy("_key", "_tie", "_place")
    placed = (ranged.withColumn("_nth", F.row_number().over(order))
              .withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .join(pieces, piece)
              .withColumn("_at", F.expr("_bytes0 + _upto - size + size div 2"))       # its middle byte
              .withColumn("_index", F.col("_rows0") + F.col("_nth") - 1)
              .withColumn("shard", F.expr(f"int(_at * {int(shards)} div {max(total, 1)})")))
    placed = materialise(placed.drop("_key", "_tie", "_place", "_nth", "_upto", "_bytes0", "_rows0", "_at"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")                  # ``shards`` rows
            .withColumn("slot", F.col("_index") - F.col("_first"))
            .drop("_index", "_first"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, *, id_col: str = "doc_id",
                 text_col: str = "text", **options) -> None:
    """Write whole records to ``path/shard=N`` as (slot, record); a shard is written by as many tasks as it has
    pieces. The record is a struct, so columns may have any names; nulls, empty texts and repeated rows
    are written as they are, and an empty table gives a folder without shards."""
    columns = tuple(docs.columns)
    placed = assign(docs, shards, id_col=id_col, text_col=text_col, keep=columns, **options)
    (placed.repartition("shard", "_range", "_lane").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", F.col("_kept").alias("record"))
     .write.partitionBy("shard").parquet(path))


def shard_table(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest rows of ``op5``: law ``bytes``."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
