"""Lines of text files, read by as many tasks as the files have splits, and numbered by carries.

Spark's text source splits large files at line ends, but a split does not know how many lines come
before it. Each line gets the byte at which its split starts (file metadata) and its order inside the task; runs of up
to ``RUN`` lines are counted, the counts of a file's runs are summed up in order (a small table), and inside a
run a window numbers the lines. No task needs a whole file. Other running counts (blank lines, say) are
carried along in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a run, as a power of two.
RUN_BITS = 16


def scan_lines(spark: SparkSession, path, line_end: str | None = None, columns: str = "") -> DataFrame:
    """``value, source, start`` and the partition ``columns`` of all files of ``path``. ``line_end``: what ends a line (by
    default each of ``\\n``, ``\\r``, ``\\r\\n``)."""
    reader = spark.read.schema("value string" + (f", {columns}" if columns else ""))
    if line_end:
        reader = reader.option("lineSep", line_end)
    return with_place(reader.text(path))


def with_place(lines: DataFrame) -> DataFrame:
    """Adds the file (``source``) and the first byte of the split (``start``) of each line; for streams, too."""
    return lines.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"))


def number_lines(lines: DataFrame, line_col: str = "line_no", counts: dict[str, Column] | None = None, run_bits: int = RUN_BITS) -> DataFrame:
    """Scanned lines with ``line_no`` (from 0 in each file) and, for each of ``counts``, how many lines up to and with
    this one fulfil a condition."""
    counts = counts or {}
    seq = lines.withColumn("_seq", F.monotonically_increasing_id())
    rows = seq.select("*", F.shiftright("_seq", run_bits).alias("_run"), *(c.cast("long").alias(f"_is_{k}") for k, c in counts.items()))
    key = ["source", "start", "_run"]
    before = Window.partitionBy("source").orderBy("start", "_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    carries = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_is_{k}").alias(f"_n_{k}") for k in counts)).select(
        *key, carried("_n").alias("_lines"), *(carried(f"_n_{k}").alias(f"_c_{k}") for k in counts))
    inside = Window.partitionBy(*key).orderBy("_seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.join(carries, key).select(
        *lines.columns, (F.col("_lines") + F.row_number().over(inside) - 1).alias(line_col),
        *((F.col(f"_c_{k}") + F.sum(f"_is_{k}").over(upto)).alias(k) for k in counts))
    return numbered
