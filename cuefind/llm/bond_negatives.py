"""Hard negatives by a vertical (BOND) scan of integer vectors.

For every anchor: its ``POSITIVES`` best rows of the same label, and for each of these the ``NEGATIVES``
best rows of other labels whose score lies in a window below the positive's score (inner products;
higher first, ties by smaller id). Both searches are exact and read vectors dimension by dimension:

* Rows lie in *blocks*, stored column by column with each dimension's smallest and largest value. A label
  with many rows has blocks of its own, small labels share them.
* An anchor takes the dimensions in descending order of its own magnitudes, ``STEP`` at a time. Partial scores
  plus what the remaining dimensions can add at least and at most (from the block's smallest and largest
  values) bound every candidate's score. Candidates that can't reach the k-th best of a window that is
  certain so far, or can't lie in any window, leave the bitmap; the columns that follow are read for the rest
  only. When all dimensions are read, the scores are exact and the windows resolve.
* Positives need only the blocks of the anchor's label; they come first, since they set the windows.

Anchors travel in groups of at most ``ANCHORS``, blocks in slices of about ``SLICE_BLOCKS``; one shuffle brings
each group and each slice together (anchors are a stated query set, run against all rows in blocks), a task holds
one of each and carries the best so far from block to block. Only k rows per anchor, window and slice leave it.
A label with a third of all rows is many blocks and many groups.

Cases: a null id, label or vector, or a null or non-finite component: the row takes no part; rows that repeat
id, label and vector are one row; rows of the anchor's id are never its positives or negatives; rows
with one id and different vectors are different rows, as anchors too; shorter vectors are filled up with
zeros; components beyond 64 bits are cut to them, and so are scores; sums that doubles can't hold
exactly are computed in whole numbers of any size; an anchor without positives, or a positive whose window is empty, has no
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefind.llm.common import materialise, per_group
from cuefind.session import ship_package

POSITIVES = 5
NEGATIVES = 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Values of a block, anchors of a group, blocks of a slice.
BLOCK_CELLS = 1 << 19
ANCHORS = 256
SLICE_BLOCKS = 4

_LONG = np.iinfo(np.int64)
_BLOCK = "home long, part int, ids binary, labels binary, columns binary, dims int"
_FOUND = "anchor_id long, tag long, place int, other_id long, score long"


class Block:
    """Some rows, column by column (``columns[d]`` holds dimension d of all of them), in order of their ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, anchor_limit: int):
        self.ids, self.labels = ids, labels
        self.one_label = labels[0] if len(labels) and (labels == labels[0]).all() else None
        most = max(abs(int(columns.min(initial=0))), abs(int(columns.max(initial=0))))
        exact = most * anchor_limit * max(1, len(columns)) < 1 << 53
        self.type = np.float64 if exact else object
        self.columns = columns.astype(self.type)
        self.low = columns.min(axis=1, initial=0).astype(self.type)
        self.high = columns.max(axis=1, initial=0).astype(self.type)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, of equal ones the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.sort(scores)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def vertical_scan(block: Block, anchor: np.ndarray, rows: np.ndarray, k: int, lows: np.ndarray, highs: np.ndarray,
                  floors: np.ndarray, counter: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window [low, high] the k best of ``rows`` (places in the block) as (places, scores).

    ``floors``: a score per window that k rows elsewhere reach already. ``counter`` adds up the values read."""
    anchor = anchor.astype(block.type)
    order = np.argsort(-np.abs(anchor), kind="stable")
    least = np.minimum(anchor * block.low, anchor * block.high)[order]
    most = np.maximum(anchor * block.low, anchor * block.high)[order]
    least_left, most_left = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (least, most))
    at, part = rows, np.zeros(len(rows), block.type)
    whole = len(rows) == len(block.ids)
    floors = np.maximum(floors.astype(block.type), lows.astype(block.type))
    for d in range(0, len(order), STEP):
        if not len(at):
            break
        dims = order[d:d + STEP]
        columns = block.columns[dims] if whole else block.columns[np.ix_(dims, at)]
        part = part + anchor[dims] @ columns
        if counter is not None:
            counter[0] += columns.size
        done = min(d + STEP, len(order))
        lower, upper = part + least_left[done], part + most_left[done]
        alive = np.zeros(len(at), bool)
        for j, (low, high) in enumerate(zip(lows, highs)):
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) >= k:
                floors[j] = max(floors[j], np.sort(sure)[-k])
            alive |= (upper >= floors[j]) & (lower <= high)
        if not alive.all():
            at, part, whole = at[alive], part[alive], False
    out = []
    for low, high in zip(lows, highs):
        inside = np.flatnonzero((part >= low) & (part <= high))
        best = inside[_best(block.ids[at[inside]], part[inside], k)]
        out.append((at[best], part[best]))
    return out


class Running:
    """The k best of each window so far, over several blocks."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(windows)]

    def floors(self, lows: np.ndarray) -> np.ndarray:
        return np.array([s.min() if len(s) >= self.k else low for (_, s), low in zip(self.found, lows)], object)

    def add(self, ids: np.ndarray, results: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for j, (rows, scores) in enumerate(results):
            if len(rows):
                all_ids = np.concatenate([self.found[j][0], ids[rows]])
                all_scores = np.concatenate([self.found[j][1], scores])
                best = _best(all_ids, all_scores, self.k)
                self.found[j] = (all_ids[best], all_scores[best])


# ---- packed rows ----------------------------------------------------------------------------------

def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors as rows of ``dims`` whole numbers."""
    vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = values[offsets[0]:offsets[-1]]
    return out


def _pack_block(dims: int):
    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        columns = np.ascontiguousarray(_matrix(rows.column("_vector"), dims)[order].T)
        labels = rows.column("_label").to_numpy()[order]
        return pa.table({"home": rows.column("home")[:1], "part": rows.column("part")[:1],
                         "ids": pa.array([ids[order].tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()),
                         "columns": pa.array([columns.tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32())})
    return pack


def _blocks(table: pa.Table, anchor_limit: int):
    for r in table.select(["ids", "labels", "columns", "dims"]).to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        columns = np.frombuffer(r["columns"], np.int64).reshape(r["dims"], len(ids))
        yield Block(ids, np.frombuffer(r["labels"], np.int64), columns, anchor_limit)


def _scan(dims: int, k: int, same_label: bool):
    """One group of anchors against the blocks of one slice."""
    def cogroup(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        vectors = _matrix(anchors.column("_vector"), dims)
        ids, labels, tags = (anchors.column(c).to_numpy() for c in ("_id", "_label", "tag"))
        if same_label:
            windows = [[(_LONG.min, _LONG.max)]] * len(ids)
        else:
            windows = [[(-(-LOW * s // 100), HIGH * s // 100) for s in scores] for scores in anchors.column("scores").to_pylist()]
        limit = int(max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0))), 1))
        best = [Running(len(w), k) for w in windows]
        for block in _blocks(blocks, limit):
            for i in range(len(ids)):
                if (block.one_label is not None) and (block.one_label == labels[i]) != same_label:
                    continue
                use = (block.labels == labels[i]) == same_label
                use &= block.ids != ids[i]
                lows, highs = (np.array(x, object) for x in zip(*windows[i]))
                best[i].add(block.ids, vertical_scan(block, vectors[i], np.flatnonzero(use), k, lows, highs, best[i].floors(lows)))
        out = [(ids[i], tags[i], j, other, min(max(int(s), _LONG.min), _LONG.max)) for i, b in enumerate(best)
               for j, (others, scores) in enumerate(b.found) for other, s in zip(others.tolist(), scores.tolist())]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)],
                                    names=["anchor_id", "tag", "place", "other_id", "score"])
    return cogroup


# ---- the two searches -------------------------------------------------------------------------------

def prepare(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
            scale: int = 256, label: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``_id, _label, _vector``: whole numbers floor(scale * x), only of rows that take part. ``label``
    may change the label, given (label, id)."""
    vector = rows[f"`{vector_col}`"].cast("array<double>")
    own, ident = rows[f"`{label_col}`"].cast("long"), rows[f"`{id_col}`"].cast("long")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return (rows.select(ident.alias("_id"), (label(own, ident) if label else own).alias("_label"), whole.alias("_vector"),
                        F.coalesce(finite, F.lit(False)).alias("_finite"))
            .where("_finite and _id is not null and _label is not null").drop("_finite"))


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], *, positives: int = POSITIVES,
         negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from prepared rows."""
    ship_package(rows.sparkSession)
    rows = materialise(rows.select("_id", "_label", "_vector").dropDuplicates()
                       .withColumn("tag", F.xxhash64("_label", "_vector"))
                       .withColumn("anchor", F.coalesce(is_anchor(F.col("_id")), F.lit(False))), "bond-rows")
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("_vector")), F.lit(0))).first()
    dims = max(1, dims)
    size = max(256, BLOCK_CELLS // dims)
    shared = max(1, n // size)              # homes of small labels
    homes = (rows.groupBy("_label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors"))
             .withColumn("home", F.when(F.col("n") >= size // 2, F.xxhash64("_label"))
                         .otherwise(F.pmod(F.xxhash64("_label"), F.lit(shared)))))
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / size).cast("int").alias("parts"),
                                      F.ceil(F.sum("n_anchors") / ANCHORS).cast("int").alias("groups"))
    homes = homes.select("_label", "home").join(parts, "home")
    rows = materialise(rows.join(homes, "_label").withColumn("part", F.pmod(F.xxhash64("_id", "tag"), "parts").cast("int")), "bond-dealt")
    schema = "home long, part int, ids binary, labels binary, columns binary, dims int"
    blocks = materialise(rows.groupBy("home", "part").applyInArrow(per_group(_pack_block(dims)), schema), "bond-blocks")
    anchors = rows.where("anchor").withColumn("_deal", F.xxhash64("tag", "_id"))

    # positives: the groups of a home against the blocks of that home
    mine_ = anchors.where("parts > 0 and groups > 0").select(
        "_id", "_label", "_vector", "tag", "home", F.pmod("_deal", "groups").cast("int").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    theirs = blocks.join(parts.where("groups > 0").select("home", "groups"), "home").select(
        "home", "part", "ids", "labels", "columns", "dims", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
    key = ["home", "part", "grp"]
    found = mine_.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(per_group(_scan(dims, positives, True)), _FOUND)
    order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "other_id")
    best = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    best = materialise(best.select("anchor_id", "tag", "place", F.col("other_id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), "bond-positives")

    # negatives: all groups against all blocks
    groups = max(1, -(-n_anchors // ANCHORS))
    slices = max(1, -(-int(blocks.count()) // SLICE_BLOCKS))
    scores = best.groupBy("anchor_id", "tag").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor_id", "_id"), ["_id", "tag"]).select(
        "_id", "_label", "_vector", "tag", "scores", F.pmod("_deal", F.lit(groups)).cast("int").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    dealt = blocks.select("ids", "labels", "columns", "dims", F.pmod(F.xxhash64("home", "part"), F.lit(slices)).cast("int").alias("slice"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    found = asked.groupBy("grp", "slice").cogroup(dealt.groupBy("grp", "slice")).applyInArrow(per_group(_scan(dims, negatives, False)), _FOUND)
    order = Window.partitionBy("anchor_id", "tag", "place").orderBy(F.desc("score"), "other_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(best, ["anchor_id", "tag", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def rows(vectors: DataFrame) -> DataFrame:
    """The rows of ``op12``: labels of ids divisible by 7 move on by one of ten, ids divisible by 50 are anchors."""
    moved = lambda label, i: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(prepare(vectors, label=moved), lambda i: i % 50 == 0)
