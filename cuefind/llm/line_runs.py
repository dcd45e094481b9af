"""Line dedup by levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case; keys of
at least ``MIN_CHARS`` code points take part, under the first 128 bits of their SHA-256. ``LineRuns``
is an index of the keys seen so far:

* A *run* is a table of (digest, number of documents, largest document id), bucketed and sorted by
  digest. Every run has the same buckets, so runs are merged and joined bucket by bucket: no run is
  shuffled again once it is written.
* ``add`` takes a batch of documents. Its keys are merge-anti-joined with every run: a key that a run
  already holds from enough documents, one of them with an id at least as large as the batch's, is
  settled and not written again. The other keys become a run of level 0.
* When a level has ``fanout`` runs, they are *compacted* to one run of the next level (counts are added,
  ids maximised), so n batches leave O(log n) runs and a key is rewritten O(log n) times.

``repeated`` merges the runs to the keys of at least ``min_docs`` documents, each with the largest id that
holds it. A document loses all lines of such a key unless it is that document (``drop_lines``). Lines
and keys are shuffled as digests; the texts are shuffled once, when the line numbers to drop are
joined to them. Hot keys: a batch counts each key before its shuffle; a line in a third of all documents is one
row per task there, and the join of lines with repeated keys is one that AQE can split.

Cases: a null or empty text is one empty line, which is shorter than any key; a document is an id, so rows
that repeat an id count once and all keep the lines of the largest id; a null id is one document, smaller than
all others; a batch must hold all rows of its ids; texts of any length are read whole; an empty table gives no
rows; other columns, whatever their names, pass through ``clean`` untouched and are not read by ``rows``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.llm.common import materialise
from cuefind.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that a whole table is added in, and the runs that a level may have.
BATCHES = 8
FANOUT = 4
#: Fixed value: what is stripped from a line's ends.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case (no other letter changes)."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def key_digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _at_least(known: Column, other: Column) -> Column:
    """``known >= other`` where null is the smallest."""
    return other.isNull() | F.coalesce(known >= other, F.lit(False))


class LineRuns:
    """The index, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, *, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.fanout, self.min_docs = spark, path, fanout, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]         # names of the runs, by level

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (entries.select("digest", "n_docs", "last_doc").write.format("parquet").option("path", f"{self.path}/{name}")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name))
        return name

    def _entries(self, lines: DataFrame) -> DataFrame:
        """One row per key of a batch of (digest, doc_id) rows."""
        return (lines.select("digest", "doc_id").distinct().groupBy("digest")
                .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch of (digest, doc_id) rows with the runs; what stays is a new run."""
        entries = self._entries(lines)
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select(
                F.col("digest").alias("_digest"), F.col("last_doc").alias("_last"))
            entries = entries.join(settled.hint("merge"), (F.col("digest") == F.col("_digest"))
                                   & _at_least(F.col("_last"), F.col("last_doc")), "left_anti")
        self.levels[0].append(self._write(entries))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level to one run of the next."""
        merged = self._merged([self.spark.table(name) for name in self.levels[level]])
        if level + 1 == len(self.levels):
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        self.levels[level + 1].append(self._write(merged))
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs of equal buckets, merged side by side: full outer joins on the bucketed digest."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select(F.col("digest").alias("_digest"), F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
            out = out.join(more.hint("merge"), F.col("digest") == F.col("_digest"), "full_outer").select(
                F.coalesce("digest", "_digest").alias("digest"),
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "_last").alias("last_doc"))
        return out

    def repeated(self) -> DataFrame:
        """``digest, last_doc`` of every key found in at least ``min_docs`` documents, written."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "digest binary, last_doc long")
        merged = self._merged(runs).where(F.col("n_docs") >= self.min_docs)
        return materialise(merged.select("digest", "last_doc"), "line-repeats")

    def close(self) -> None:
        """Forget the runs' names (their files stay in the folder)."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """``batch, digest, doc_id, text_key, line``: the lines that take part, by their place in the text."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(text.cast("string")).alias("text_key"),
                       F.posexplode(_lines(text)).alias("line", "raw"))
    rows = rows.withColumn("key", line_key(F.col("raw"))).where(F.char_length("key") >= MIN_CHARS)
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
                       key_digest(F.col("key")).alias("digest"), "doc_id", "text_key", "line")


def drop_lines(docs: DataFrame, lines: DataFrame, repeated: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (the user's row as a struct), ``_id, _kept, _n_lines, _n_dropped`` per document."""
    hot = repeated.select("digest", F.col("last_doc").alias("_last")).hint("merge")
    gone = (lines.join(hot, "digest").where(~_at_least(F.col("doc_id"), F.col("_last")))
            .groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("_gone"))
            .select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), "_gone"))
    others = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    text = docs[f"`{text_col}`"]
    base = docs.select(F.struct(*others, F.lit(None).cast("int").alias("none")).alias("_row"),
                       docs[f"`{id_col}`"].cast("long").alias("_id"), F.xxhash64(text.cast("string")).alias("_key"),
                       text.isNull().alias("_null"), _lines(text).alias("_lines"))
    joined = base.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    left = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    kept = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(left), "\n")
    return joined.select("_row", "_id", "_null", kept.alias("_kept"), F.size("_lines").cast("long").alias("_n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_dropped"))


def _run(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    keyed_lines(docs, id_col, text_col, batches).write.partitionBy("batch").parquet(path)
    schema = "digest binary, doc_id long, text_key long, line int, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, scratch_path(spark, "line-runs"))
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    repeated = runs.repeated()
    runs.close()
    return drop_lines(docs, lines, repeated, id_col=id_col, text_col=text_col)


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
          batches: int = BATCHES) -> DataFrame:
    """The documents without their repeated lines (``chars_col``, if there, brought in line; a null text stays null)."""
    out = _run(docs, id_col, text_col, batches)
    types = {f.name: f.dataType for f in docs.schema}
    text = F.when(~F.col("_null"), F.col("_kept"))
    new = {text_col: text.cast(types[text_col])}
    if chars_col in types and chars_col != text_col:
        new[chars_col] = F.length(text).cast(types[chars_col])
    return out.select(*(new.get(c, F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The digest rows of ``op11``: ``doc_id, n_lines, n_dropped, kept_sha256`` per document."""
    out = _run(docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]), id_col, text_col, batches)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"),
                      F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))
