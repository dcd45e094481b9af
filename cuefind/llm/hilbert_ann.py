"""Nearest neighbours (largest inner product) by shifted space-filling curves.

1. Equal vectors are one point; with it go its smallest ids (as many as a result can hold). A vector
   that a third of all rows share is one point, not a group.
2. ``orderings`` Hilbert curves. For inner products, points get one more coordinate that makes all
   norms equal, so that the largest product is the smallest distance. Each ordering projects them
   on ``dims`` random orthonormal directions, shifts them by a random share of the grid, and sorts
   them along its curve.
3. *Window.* Bounded samples (documented below) give, per ordering, the key quantiles that splits
   are chosen by, and, by one exact scan for ``probes`` queries, how far along the best ordering
   their true neighbours lie. The window is the distance that covers ``recall`` of them. On vectors
   with structure it is narrow; on directions at random it grows to whatever that recall needs.
4. Every point goes to its block of every ordering, by range of key; every query to the blocks that
   its window meets. Blocks follow the table: ``BLOCKS`` of them, more from ``BLOCKS * block_points`` points on. A pair
   is scored in the first ordering whose window holds it and left out in the others: points carry their
   blocks of all orderings, queries their windows. Scores are products in double precision; a block returns each
   query's best, and the best of all blocks are ranked by a window function that keeps k of a task.
   Copies of points are put in, the query's own id is left out.

Nothing is capped: every point is in one block of every ordering, and a block that many equal keys
overfill is split into tiles that are searched alike. A window that reaches both ends is
an exact search.

Cases: vectors that are null or zero, or hold a null, NaN or infinite component, take no part, and
so do rows without an id; rows that repeat id and vector count once; vectors are only compared with
vectors of as many components; ties go to the smaller id; fewer candidates than ``k`` give fewer
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuefind.llm.common import in_arrow, materialise, per_group, salted_join, spread
from cuefind.session import ship_package

ORDERINGS = 12
DIMS = 6
BITS = 5
#: Documented bounds of the samples: keys for the quantiles, exact queries for the window.
SAMPLE = 20_000
PROBES = 64
BLOCK_POINTS = 2048
#: Blocks that also a small table is cut into, of at least LEAST_POINTS points.
BLOCKS = 32
LEAST_POINTS = 16
RECALL = 0.94
#: Bytes of cell sizes that are broadcast.
CELL_BYTES = 4 << 20
#: Bytes of a sample on the driver.
SAMPLE_BYTES = 32 << 20
_SEED = 7


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (row of ``dims`` integers below 2^bits) on the Hilbert curve.

    From the highest bit down, a cell's quadrant turns the frame of the bits below it (reflect or
    swap with the first axis); then the Gray code of the turned axes is read off bit by bit.
    """
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(dims):
            upper = (x[axis] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(upper, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> level & 1)
    return key


@dataclass
class Curves:
    """The orderings for vectors of one length, fitted on a sample."""

    norm: float                         # largest norm of all points
    axes: np.ndarray                    # ordering, component (one more than the vectors have), dims
    low: np.ndarray
    span: np.ndarray
    shift: np.ndarray
    quantiles: list[np.ndarray]         # per ordering: sorted keys of the sample

    def keys(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Key of each vector in each ordering (ordering x vector)."""
        length = np.linalg.norm(vectors, axis=1)
        if query:
            extra, vectors = np.zeros(len(vectors)), vectors * (self.norm / length)[:, None]
        else:
            extra = np.sqrt(np.maximum(self.norm ** 2 - length ** 2, 0))
        wide = np.column_stack([vectors, extra])
        out = np.empty((len(self.axes), len(vectors)), np.int64)
        for o, axes in enumerate(self.axes):
            cell = ((wide @ axes - self.low[o]) / self.span[o] * 0.75 + self.shift[o]) * (1 << BITS)
            out[o] = hilbert_key(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS)
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Share of the points before each key: the middle of the quantiles that equal it."""
        return np.stack([(np.searchsorted(q, k, "left") + np.searchsorted(q, k, "right")) / (2 * max(len(q), 1))
                         for q, k in zip(self.quantiles, keys)])


def fit(sample: np.ndarray, norm: float, orderings: int, dims: int) -> Curves:
    rng = np.random.default_rng(_SEED)
    wide = sample.shape[1] + 1
    dims = min(dims, wide)
    axes = np.stack([np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, :dims] for _ in range(orderings)])
    shift = rng.random((orderings, dims)) * 0.25
    extra = np.sqrt(np.maximum(norm ** 2 - (sample ** 2).sum(1), 0))
    seen = np.einsum("nc,ocd->ond", np.column_stack([sample, extra]), axes)
    low = seen.min(axis=1)
    curves = Curves(norm, axes, low, np.maximum(seen.max(axis=1) - low, 1e-12), shift, [])
    curves.quantiles = [np.sort(k) for k in curves.keys(sample, query=False)]
    return curves


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _key(vector) -> F.Column:
    """128 bits of a vector's hash, as text."""
    return F.concat_ws(".", F.xxhash64(vector).cast("string"), F.xxhash64(F.lit(1), vector).cast("string"))


def _vectors(vectors: DataFrame, vector_col: str) -> F.Column:
    """The vectors as they are: single precision stays, all else becomes double."""
    kind = vectors.schema[vector_col].dataType.elementType
    return vectors[f"`{vector_col}`"].cast("array<float>" if isinstance(kind, T.FloatType) else "array<double>")


def _points(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Distinct vectors: ``point`` (a key for each), ``embedding``, ``ids`` (its k+1 smallest)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), _vectors(vectors, vector_col).alias("embedding"))
            .where(F.col("id").isNotNull() & F.col("embedding").isNotNull())
            .where((F.size("embedding") > 0) & good & F.exists("embedding", lambda x: x != 0)).distinct())
    first = Window.partitionBy("embedding").orderBy("id")       # limited per task before the shuffle
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    return (few.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(_key(F.col("embedding")).alias("point"), "embedding", "ids", F.size("embedding").alias("dim")))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores (smallest first id among equals at the edge), best first."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _met_before(ordering: int, blocks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Pairs (query, point) that an earlier ordering's window holds."""
    out = np.zeros((len(low), len(blocks)), bool)
    for o in range(ordering):
        out |= (blocks[:, o] >= low[:, o, None]) & (blocks[:, o] <= high[:, o, None])
    return out


def _block_search(k: int, orderings: int, blocks: int, tile: int = 256):
    """Per query of a block its best points that no earlier ordering has brought it to: ids and scores."""
    def cogroup(points: pa.Table, queries: pa.Table) -> pa.Table:
        names, found, values, scored = [], [], [], []
        if points.num_rows and queries.num_rows:
            ordering, dim = points.column("cell")[0].as_py() // blocks, points.column("dim")[0].as_py()
            x = _matrix(points.column("embedding").combine_chunks(), dim)
            ids = points.column("ids").to_pylist()
            first = np.array([i[0] for i in ids], np.int64)
            alone = all(len(i) == 1 for i in ids)
            seen = np.frombuffer(b"".join(points.column("seen").to_pylist()), np.int32).reshape(-1, orderings)
            window = np.frombuffer(b"".join(queries.column("seen").to_pylist()), np.int32).reshape(-1, 2, orderings)
            q = _matrix(queries.column("embedding").combine_chunks(), dim)
            own = queries.column("point").to_pylist()
            for a in range(0, len(q), tile):
                skip = _met_before(ordering, seen, window[a:a + tile, 0], window[a:a + tile, 1])
                scores = q[a:a + tile] @ x.T
                scores[skip] = -np.inf
                left = len(x) - skip.sum(axis=1)
                for name, row, n in zip(own[a:a + tile], scores, left.tolist()):
                    top = _best(row, first, k + 1)[:n]
                    if not len(top):
                        continue
                    names.append(name)
                    scored.append(n)
                    if alone:
                        found.append(first[top])
                        values.append(row[top])
                    else:
                        pairs = [(i, row[p]) for p in top.tolist() for i in ids[p]]
                        pairs = sorted(pairs, key=lambda p: (-p[1], p[0]))[:k + 1]
                        found.append(np.array([p[0] for p in pairs], np.int64))
                        values.append(np.array([p[1] for p in pairs], np.float64))
        return pa.table({"point": pa.array(names, pa.string()), "found": pa.array(found, pa.list_(pa.int64())),
                         "scores": pa.array(values, pa.list_(pa.float64())), "scored": pa.array(scored, pa.int64())})
    return cogroup


def _exact_probe(points: DataFrame, probe: np.ndarray, dim: int, k: int) -> list[np.ndarray]:
    """The k nearest points of a few queries, by one scan: each task keeps k of a query."""
    def kernel(batches):
        held_s, held_x = np.full((len(probe), 0), 0.0), np.zeros((len(probe), 0, dim))
        for rb in batches:
            x = _matrix(rb.column("embedding"), dim)
            s = np.concatenate([held_s, probe @ x.T], axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            both = [np.concatenate([held_x[i], x]) for i in range(len(probe))]
            held_s = np.take_along_axis(s, top, axis=1)
            held_x = np.stack([b[t] for b, t in zip(both, top)])
        rows = [(i, float(s), x.tolist()) for i in range(len(probe)) for s, x in zip(held_s[i], held_x[i])]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()),
                                          pa.array(cols[2], pa.list_(pa.float64()))], ["probe", "score", "vector"])

    found = in_arrow(points.select("embedding"), kernel, "probe int, score double, vector array<double>")
    order = Window.partitionBy("probe").orderBy(F.desc("score"))
    rows = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).collect()   # probes * k rows
    return [np.array([r["vector"] for r in rows if r["probe"] == i]).reshape(-1, dim) for i in range(len(probe))]


def window_width(curves: Curves, probe: np.ndarray, near: list[np.ndarray], recall: float) -> float:
    """Half the window, as a share of all points: in the best ordering, ``recall`` of the true
    neighbours of the probes lie no farther off."""
    far: list[float] = []
    for q, x in zip(probe, near):
        if len(x):
            at = curves.place(curves.keys(q[None, :], query=True))
            far += np.abs(curves.place(curves.keys(x, query=False)) - at).min(axis=0).tolist()
    return float(np.quantile(far, recall)) if far else 1.0


def _dealt(points: DataFrame, curves: Curves, blocks: int, width: float | None, dim: int) -> DataFrame:
    """``cell``: the block of each point in each ordering (``width`` None), or the blocks that a query's
    window meets. ``seen``: the blocks of a point in all orderings, or the first and last of a query's windows."""
    def kernel(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            at = curves.place(curves.keys(_matrix(rb.column("embedding"), dim), query=width is not None))
            reach = width or 0.0
            low = np.clip(((at - reach) * blocks).astype(np.int64), 0, blocks - 1)
            high = np.clip(((at + reach) * blocks).astype(np.int64), 0, blocks - 1)
            seen = low.T if width is None else np.stack([low.T, high.T], axis=1)
            seen = pa.array([x.tobytes() for x in np.ascontiguousarray(seen.astype(np.int32))], pa.binary())
            low, size = low.ravel(), (high - low + 1).ravel()
            row = pa.array(np.repeat(np.tile(np.arange(rb.num_rows), len(at)), size))
            ordering = np.repeat(np.repeat(np.arange(len(at)), rb.num_rows), size)
            own = rb.take(row)
            yield pa.RecordBatch.from_arrays([*own.columns, seen.take(row), pa.array(ordering * blocks + spread(low, size))],
                                             [*own.schema.names, "seen", "cell"])

    return in_arrow(points, kernel, T.StructType([*points.schema.fields, T.StructField("seen", T.BinaryType()),
                                                  T.StructField("cell", T.LongType())]))


def _tiles(points: DataFrame, queries: DataFrame, block_points: int) -> tuple[DataFrame, DataFrame]:
    """Points and queries of every cell (block of an ordering) that has both. A cell of many equal
    keys is split: its points by hash over ``p`` tiles, its queries over ``q``, every pair of them a task."""
    many = lambda df, most: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_parts"))
    sizes = materialise(many(points, 2 * block_points).withColumnRenamed("_parts", "_p")
                        .join(many(queries, 2048).withColumnRenamed("_parts", "_q"), "cell"), "hilbert-cells")
    own = lambda parts: F.pmod(F.xxhash64("point", "cell"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    # a cell is 16 bytes here; as few as fit are sent to the points, else the points come to them
    few = sizes.count() * 16 <= CELL_BYTES
    sized = lambda df: df.join(F.broadcast(sizes), "cell") if few else salted_join(df, sizes, "cell", "point", "inner")
    p = sized(points).withColumn("p", own("_p")).withColumn("q", every("_q"))
    q = sized(queries).withColumn("q", own("_q")).withColumn("p", every("_p"))
    return p.drop("_p", "_q"), q.drop("_p", "_q")


def block_count(n: int, block_points: int) -> int:
    """Blocks of an ordering of n points."""
    return int(max(1, min(BLOCKS, n // LEAST_POINTS), n // block_points))


def _searched(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str, orderings: int, dims: int, recall: float,
              sample: int, probes: int, block_points: int) -> tuple[DataFrame, DataFrame | None]:
    """The queries (query_id, point), and per query point and block: ids, scores and the number of pairs scored."""
    ship_package(vectors.sparkSession)
    points = materialise(_points(vectors, id_col, vector_col, k), "hilbert-points")
    asked = (vectors.select(vectors[f"`{id_col}`"].cast("long").alias("query_id"), _vectors(vectors, vector_col).alias("embedding"))
             .where(F.col("query_id").isNotNull() & is_query(F.col("query_id"))).distinct()
             .select("query_id", _key(F.col("embedding")).alias("point")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = materialise(asked, "hilbert-queries")
    queries = points.join(asked.select("point").distinct(), "point", "left_semi")
    found = None
    for row in points.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect():    # a few lengths
        dim, n = row["dim"], row["n"]
        own = points.where(F.col("dim") == dim)
        own_queries = queries.where(F.col("dim") == dim)
        mixed = F.xxhash64("point", F.lit("sample"))
        drawn = own.select("embedding").orderBy(mixed).limit(max(64, min(sample, SAMPLE_BYTES // (8 * dim)))).toPandas()["embedding"]
        curves = fit(np.stack(drawn.to_numpy()).astype(np.float64), float(row["norm"]), orderings, dims)
        probe = own_queries.select("embedding").orderBy(mixed).limit(probes).toPandas()["embedding"]
        if not len(probe):
            continue
        probe = np.stack(probe.to_numpy()).astype(np.float64)
        width = window_width(curves, probe, _exact_probe(own, probe, dim, k + 1), recall)
        blocks = block_count(n, block_points)
        p, q = _tiles(_dealt(own, curves, blocks, None, dim),
                      _dealt(own_queries.drop("ids"), curves, blocks, width, dim), max(LEAST_POINTS, min(block_points, n // blocks)))
        key = ["cell", "p", "q"]
        part = (p.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(
            per_group(_block_search(k, orderings, blocks)), "point string, found array<long>, scores array<double>, scored long"))
        found = part if found is None else found.unionByName(part)
    return asked, found


def search(vectors: DataFrame, is_query, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
           orderings: int = ORDERINGS, dims: int = DIMS, recall: float = RECALL, sample: int = SAMPLE,
           probes: int = PROBES, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every row whose id fulfils ``is_query``."""
    asked, found = _searched(vectors, is_query, k, id_col, vector_col, orderings, dims, recall, sample, probes, block_points)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = found.select("point", F.inline(F.arrays_zip("found", "scores"))).withColumnsRenamed({"found": "vec_id", "scores": "score"})
    ranked = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    best = rows.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)     # its own id may be among them
    merged = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    pairs = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    return (salted_join(asked, merged, "point", "query_id", "inner")
            .select("query_id", F.posexplode(pairs).alias("_n", "_pair"))
            .select("query_id", (F.col("_n") + 1).cast("int").alias("rank"), F.col("_pair.vec_id").alias("vec_id"),
                    F.col("_pair.score").alias("score")))


def scored_pairs(vectors: DataFrame, is_query, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
                 orderings: int = ORDERINGS, dims: int = DIMS, recall: float = RECALL, sample: int = SAMPLE,
                 probes: int = PROBES, block_points: int = BLOCK_POINTS) -> int:
    """How many (query, point) pairs a search scores."""
    _, found = _searched(vectors, is_query, k, id_col, vector_col, orderings, dims, recall, sample, probes, block_points)
    return 0 if found is None else found.agg(F.sum("scored")).first()[0] or 0
