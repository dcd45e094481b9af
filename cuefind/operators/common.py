"""Shared plan helpers: byte-checked semi-joins and per-key top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefind.session import reliable_checkpoint

#: Largest key set (bytes of the keys) that is broadcast.
BROADCAST_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the session can run at once
    (e.g. one unsplittable file), so per-row work is not done by a single task. A wide
    input is returned untouched: no shuffle at scale."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def rows_with_keys(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``big`` whose ``key`` is in ``keys``: the distinct keys are written once, their
    bytes summed, and up to ``BROADCAST_BYTES`` they are broadcast, so that ``big`` does not move;
    beyond that it is a shuffle semi-join. The rows are the same."""
    few = reliable_checkpoint(keys.where(F.col(key).isNotNull()).select(key).distinct())
    size = few.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 16)).first()[0] or 0
    return big.join(F.broadcast(few) if size <= BROADCAST_BYTES else few, key, "left_semi")


def top_k_per_key(df: DataFrame, key, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """row_number() <= k per key. Catalyst plans a partial WindowGroupLimit before the
    shuffle, so only k rows per key per partition move, however hot the key."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
