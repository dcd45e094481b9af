"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.session import scratch_path, ship_package

#: What lies between two words: everything but ``[^\x20\x09-\x0D]``.
WORD_GAP = "[ \t-\r]+"
#: Bytes of text that a kernel takes at a time (one longer text is taken alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table: other columns never meet those an operator adds."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written under ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks and stages, and
    allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim is not None:
        trim(0)


@functools.lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):       # a C library without it
        return None


def in_arrow(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers, which give memory back after each partition."""
    ship_package(df.sparkSession)

    def run(batches):
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


def per_group(kernel):
    """The same for a function on whole groups (or on pairs of them)."""
    def run(*groups: pa.Table) -> pa.Table:
        out = kernel(*groups)
        give_back()
        return out

    two = len(inspect.signature(kernel).parameters) == 2
    return (lambda a, b: run(a, b)) if two else (lambda a: run(a))


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str, salts: int = 16) -> DataFrame:
    """Equi-join of ``many`` with ``one`` (unique in ``key``) that deals the rows of each key
    over ``salts`` tasks by a hash of column ``spread``; the small side is repeated. It is always a
    sort-merge join: the repeated side's size isn't known to the planner, so it must not be broadcast."""
    many = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(one.hint("merge"), [key, "_salt"], how).drop("_salt")


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut, between rows, into slices of about ``limit`` bytes of ``column``."""
    for rb in batches:
        if not rb.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, rb.num_rows]):
            yield rb.slice(int(a), int(b - a))


@dataclass
class Words:
    """The words of some texts: ``codes`` into ``vocab``, text i at ``start[i]:start[i+1]``."""

    codes: np.ndarray
    start: np.ndarray
    vocab: pa.StringArray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.start) - 1), self.counts)

    def total(self, per_word: np.ndarray) -> np.ndarray:
        """Sum per text of a number that each vocabulary entry has."""
        return segment_sum(per_word[self.codes], self.start)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        import pandas as pd
        key = f"cuefind-words-{seed:02d}"[:16]
        own = pd.util.hash_array(np.asarray(self.vocab.to_pylist(), dtype=object), hash_key=key, categorize=False) \
            if len(self.vocab) else np.zeros(0, np.uint64)
        return own[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def segment_sum(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``values[start[i]:start[i+1]]`` (0 for an empty segment)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[start[1:]] - total[start[:-1]]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + size[i] - 1 of all i in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def split_words(texts: pa.Array) -> Words:
    """Words of each text (a null text has none)."""
    parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.string()), ""), pattern=WORD_GAP)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocab = coded.dictionary
    offsets = offsets - offsets[0]
    real = pc.not_equal(vocab, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    start = np.concatenate([[0], np.cumsum(real)])[offsets]
    return Words(codes[real], start, vocab)
