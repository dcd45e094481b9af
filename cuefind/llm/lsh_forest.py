"""N-gram Jaccard self-join with a MinHash LSH forest.

Two documents are linked if the Jaccard similarity of their word 5-gram sets is at least 0.8.
A text with fewer than five words has one gram, its whole word sequence; a text without words has
none and is linked to nothing.

1. Documents with one gram set are one *text*; its smallest id stands for it from here on.
2. *Forest.* Each of ``trees`` trees is a prefix trie of min-hashes. The full prefix is the longest that meets the
   target recall if all trees use it (1 - (1 - t^d)^trees). It is shortened, text by text and tree by tree, as
   the data allow: up to ``SHORTER`` levels, where the trie node of the shorter prefix holds no more than
   ``CROWD`` texts. All texts below a node are cut there alike, so whoever shares one text's prefix is in its
   leaf, and a shorter prefix only adds candidates: the recall is at least the target for every text, more where
   texts are sparse. Texts of one leaf (node) are candidates. No text leaves the forest before the last tree: that
   a node is small says that a text's min-hashes differ there from its near copies', so t^d is no longer
   the chance to meet them in such trees (tried: links of large groups were lost).
3. Nodes are compared in tiles of at most ``tile`` texts a side: pairs of tiles of one node are
   separate tasks, so no node has to fit one. A pair belongs to the first tree in which it meets,
   so it is compared once, and it is passed on only if its min-hashes agree often enough
   (five standard deviations below the threshold: the loss, under 1e-6, is part of ``recall``).
4. *Verification* counts the common grams exactly, per tile, for the pairs that are left. A tile
   returns, per text, its number of links and a spanning forest of them, never the pairs.
5. Classes are the connected components of the links, by min-label passes over that forest in Spark.

Result: ``doc_id, class_id`` (smallest id of the class) and ``n_links``: the documents linked to this
one, copies included, so a copy counts its fellows and all their partners' copies.

Cases: null and empty texts are alone (0 links); a null id is carried as null, and such a document
is alone; rows that repeat an id are copies of it (one row out for each row in; if their texts
differ, the row's own text decides); an empty table gives no rows; texts of any length are read
whole; other columns are not read (``first_of_class`` passes them through).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefind.llm.common import in_arrow, materialise, salted_join, segment_sum, split_words, text_slices
from cuefind.operators.common import rows_with_keys

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
TREES = 20
DEPTH = 8
TILE = 256
#: Levels that a prefix may be shortened by, and the texts that a node may then hold.
SHORTER = 2
CROWD = 32
#: Gram hashes that are min-hashed at a time.
_STEP = 1 << 15


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that meets the target recall if every tree uses it."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def agreement_floor(hashes: int, threshold: float = THRESHOLD) -> int:
    """Fewest equal min-hashes of a pair that is still verified."""
    return math.floor(hashes * threshold - 5 * math.sqrt(hashes * threshold * (1 - threshold)))


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes per text, flat, and where each text starts."""
    words = split_words(texts)
    h, n, owner = words.hashes(4), words.counts, words.owner()
    out = np.zeros(max(len(h) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(out)]
    place = np.arange(len(out)) - words.start[:-1][owner[:len(out)]]
    whole = place + GRAM <= n[owner[:len(out)]]
    grams, of = out[whole], owner[:len(out)][whole]
    few = np.flatnonzero((n > 0) & (n < GRAM))          # the whole sequence is the one gram
    if len(few):
        short = n[few].astype(np.uint64)
        for k in range(GRAM - 1):
            at = np.minimum(words.start[few] + k, len(h) - 1)
            short = np.where(n[few] > k, short * np.uint64(0xD6E8FEB86659FD93) + h[at], short)
        grams, of = np.concatenate([grams, short]), np.concatenate([of, few])
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])] if len(grams) else np.zeros(0, bool)
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(n) + 1))


def signatures(grams: np.ndarray, start: np.ndarray, hashes: int) -> np.ndarray:
    """``hashes`` min-hashes (32 bits) per non-empty set; rows of empty sets are zero."""
    rng = np.random.default_rng(20240101)
    mul = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    add = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    out = np.zeros((len(start) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(start) > 0)
    if not len(full):
        return out
    first = start[full]
    for k in range(hashes):         # one pass of vector arithmetic per hash, in pieces that stay in cache
        low = np.empty(len(grams), np.uint32)
        for a in range(0, len(grams), _STEP):
            low[a:a + _STEP] = (grams[a:a + _STEP] * mul[k] + add[k]) >> np.uint64(32)
        out[full, k] = np.minimum.reduceat(low, first)
    return out


def _set_key(grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit number per set: equal sets have equal ones."""
    mixed = (grams ^ (grams >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    a, b = segment_sum(grams, start), segment_sum(mixed ^ (mixed >> np.uint64(31)), start)
    return ((a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _text_rows(docs: DataFrame, id_col: str, text_col: str, hashes: int, with_sets: bool = False,
               row_col: str | None = None) -> DataFrame:
    """Per document: row number (if there is one), id, ``tid`` (of its gram set), number of grams and
    signature, or the set itself."""
    source = docs.select((F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
                         F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches):
        for rb in text_slices(batches, "text"):
            grams, start = gram_sets(rb.column("text"))
            what = [grams[a:b].tobytes() for a, b in zip(start[:-1], start[1:])] if with_sets else \
                [row.tobytes() for row in signatures(grams, start, hashes)]
            yield pa.RecordBatch.from_arrays(
                [rb.column("row"), rb.column("doc_id"), pa.array(_set_key(grams, start)), pa.array(np.diff(start).astype(np.int64)),
                 pa.array(what, pa.binary())], ["row", "doc_id", "tid", "grams", "data"])

    return in_arrow(source, kernel, "row long, doc_id long, tid long, grams long, data binary")


# ---- candidates ---------------------------------------------------------------------------------

def _paths(data: list[bytes], trees: int, depth: int) -> np.ndarray:
    """Trie nodes on the way down, per text, tree and level: a hash of tree and prefix."""
    sig = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), trees, depth)
    node = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (len(data), trees)).copy()
    out = np.empty((len(data), trees, depth), np.uint64)
    for k in range(depth):
        node = (node ^ sig[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        node ^= node >> np.uint64(29)
        out[:, :, k] = node
    return out


def _crowds(texts: DataFrame, trees: int, depth: int, crowd: int) -> DataFrame:
    """``tid, deep`` (array of tree, prefix length): where a text's prefix is longer than the shortest, because more than
    ``crowd`` texts share the shorter one. Level by level: a node is counted (before it is shuffled), its
    texts go on only if it is crowded."""
    least = max(1, depth - SHORTER)

    def kernel(batches):
        for rb in batches:
            if rb.num_rows:
                paths = _paths(rb.column("data").to_pylist(), trees, depth)[:, :, least - 1:depth - 1].view(np.int64)
                tree = pa.array(np.tile(np.arange(trees, dtype=np.int32), rb.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [rb.column("tid").take(pa.array(np.repeat(np.arange(rb.num_rows), trees))), tree,
                     *(pa.array(paths[:, :, k].ravel()) for k in range(depth - least))],
                    ["tid", "tree", *(f"node{d}" for d in range(least, depth))])

    if least == depth:
        return texts.sparkSession.createDataFrame([], "tid long, deep array<struct<tree: int, length: int>>")
    nodes = ", ".join(f"node{d} long" for d in range(least, depth))
    here, deep = in_arrow(texts.select("tid", "data"), kernel, f"tid long, tree int, {nodes}"), None
    for d in range(least, depth):
        crowded = here.groupBy(f"node{d}").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
        here = materialise(rows_with_keys(here, crowded, f"node{d}"), "forest-crowds")
        longer = here.select("tid", "tree", F.lit(d + 1).alias("length"))
        deep = longer if deep is None else deep.unionByName(longer)
    return deep.groupBy("tid").agg(F.collect_list(F.struct("tree", "length")).alias("deep"))


def prefix_lengths(deep: list[list[tuple[int, int]]], trees: int, depth: int) -> np.ndarray:
    """Per text and tree: the prefix length at which it ends."""
    out = np.full((len(deep), trees), max(1, depth - SHORTER))
    for i, rows in enumerate(deep):
        for tree, length in rows:
            out[i, tree] = max(out[i, tree], length)
    return out


def _leaves(texts: DataFrame, crowds: DataFrame, trees: int, depth: int) -> DataFrame:
    """Per text its leaf of each tree. With it, for the pair
    test: the short names of these leaves and one byte of every min-hash."""
    source = texts.select("tid", "copies", "grams", "data").join(crowds, "tid", "left")

    def kernel(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            data = rb.column("data").to_pylist()
            deep = [[(x["tree"], x["length"]) for x in rows or ()] for rows in rb.column("deep").to_pylist()]
            lengths = prefix_lengths(deep, trees, depth)
            leaf = np.take_along_axis(_paths(data, trees, depth), lengths[:, :, None] - 1, axis=2)[:, :, 0]
            sketch = np.frombuffer(b"".join(data), np.uint32).reshape(rb.num_rows, -1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [rb.column("tid"), rb.column("copies"), rb.column("grams"),
                 pa.array([x.tobytes() for x in (leaf >> np.uint64(32)).astype(np.uint32)], pa.binary()),
                 pa.array([x.tobytes() for x in sketch], pa.binary()),
                 pa.array(list(np.ascontiguousarray(leaf).view(np.int64)), pa.list_(pa.int64()))],
                ["tid", "copies", "grams", "names", "sketch", "nodes"])

    return in_arrow(source, kernel, "tid long, copies long, grams long, names binary, sketch binary, nodes array<long>")


_TILE = ["tree", "node", "lo", "hi"]
_MEMBER = "tid long, copies long, grams long, names binary, sketch binary, tree int, node long, part int, lo int, hi int"


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Members of a node of ``n`` texts in ceil(n / tile) parts, each part sent to its pairs of parts."""
    return (members.withColumn("_parts", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("tid", "tree"), F.col("_parts")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(*_TILE).sortWithinPartitions(*_TILE)


def _whole_tiles(batches, rows: int = 4096, size: int = 32 << 20):
    """The sorted rows of a partition in runs of whole tiles, of about ``rows`` rows or ``size`` bytes;
    with each, the tile number of its rows."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        keys = np.column_stack([t.column(k).to_numpy() for k in _TILE])
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        end = len(keys) if last else int(np.flatnonzero(new)[-1])
        return t.slice(0, end), np.cumsum(new)[:end], t.slice(end)

    for rb in batches:
        for a in range(0, rb.num_rows, 512):
            held.append(rb.slice(a, 512))
            if sum(x.num_rows for x in held) >= rows or sum(x.get_total_buffer_size() for x in held[-1:]) * len(held) >= size:
                done, tiles, rest = cut(False)
                if done.num_rows:
                    yield done, tiles
                held = rest.to_batches()
    if held and sum(x.num_rows for x in held):
        done, tiles, _ = cut(True)
        yield done, tiles


def _wanted(t: pa.Table, tiles: np.ndarray, trees: int, floor: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows i < j of one tile) that are to be verified here, a bounded number at a time."""
    n = t.num_rows
    col = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(n, -1)
    names, sketch = col("names", np.uint32), col("sketch", np.uint8)
    grams, tree, part = (t.column(x).to_numpy() for x in ("grams", "tree", "part"))
    across = t.column("lo").to_numpy() != t.column("hi").to_numpy()
    partners = np.searchsorted(tiles, tiles, "right") - np.arange(n) - 1
    out = []
    upto = np.cumsum(partners)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 100_000, "right")))
        i = np.repeat(np.arange(a, b), partners[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners[a:b]) - partners[a:b], partners[a:b])
        ok = np.minimum(grams[i], grams[j]) >= threshold * np.maximum(grams[i], grams[j])
        ok &= ~across[i] | (part[i] != part[j])
        i, j = i[ok], j[ok]
        met = (names[i] == names[j]) & (np.arange(trees) < tree[i][:, None])      # in an earlier tree
        i, j = i[~met.any(1)], j[~met.any(1)]
        ok = (sketch[i] == sketch[j]).sum(1) >= floor
        out.append((i[ok], j[ok]))
        a = b
    i, j = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return i, j


def _candidate_kernel(trees: int, floor: int, threshold: float):
    """The members of tiles that have a pair to verify there."""
    def kernel(batches):
        for t, tiles in _whole_tiles(batches):
            i, j = _wanted(t, tiles, trees, floor, threshold)
            yield from t.take(pa.array(np.union1d(i, j))).to_batches()
    return kernel


# ---- verification -------------------------------------------------------------------------------

def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (sorted by i) are links: common grams counted exactly, one text against
    some of its partners at a time."""
    size = np.array([len(s) for s in sets], np.int64)
    ok = np.zeros(len(i), bool)
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    for a, b in zip(first, np.r_[first[1:], len(i)]):
        own = sets[i[a]]
        for c in range(a, b, 64):
            some = j[c:min(c + 64, b)]
            flat = np.concatenate([sets[x] for x in some])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
            ok[c:c + len(some)] = common >= threshold * (len(own) + size[some] - common) - 1e-9
    return ok


def _verify_kernel(trees: int, floor: int, threshold: float):
    """Per text with links in some tiles: copies linked to it (``links``), and one text of its part of
    the spanning forest (``to``)."""
    def kernel(batches):
        for t, tiles in _whole_tiles(batches):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            i, j = _wanted(t, tiles, trees, floor, threshold)
            ok = _linked(sets, i, j, threshold)
            i, j = i[ok], j[ok]
            tid, copies = t.column("tid").to_numpy(), t.column("copies").to_numpy()
            links = np.bincount(i, copies[j], t.num_rows) + np.bincount(j, copies[i], t.num_rows)
            root = list(range(t.num_rows))

            def find(x):
                while root[x] != x:             # noqa: B023
                    root[x] = root[root[x]]     # noqa: B023
                    x = root[x]                 # noqa: B023
                return x

            for a, b in zip(i.tolist(), j.tolist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            has = np.flatnonzero(links)
            top = np.array([find(x) for x in has.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tid[has]), pa.array(links[has].astype(np.int64)), pa.array(tid[top])], ["tid", "links", "to"])
    return kernel


# ---- classes ------------------------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, label`` (smallest node reachable) for the nodes of undirected ``edges``.

    Alternates two steps over written tables: every node hooks its larger neighbours, then its
    smaller ones, to the smallest neighbour it knows, until no edge changes. Each keeps at most one
    row per edge, and a node's minimum is a partial aggregate, so a node with very many edges is
    summed before it is shuffled.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = materialise(edges, "components"), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (salted_join(both, low, "u", "v", "inner").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        hooked = large.where("u <> v").distinct()
        low = hooked.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(hooked, low, "u", "v", "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
    raise RuntimeError("components did not settle")


# ---- the operator -------------------------------------------------------------------------------

def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, trees: int, depth: int,
             tile: int, crowd: int = CROWD, row_col: str | None = None) -> DataFrame:
    """Per document: ``row``, the three columns of ``join`` and ``label``, the class itself (documents
    that share an id can be in different classes); null for a document that is linked to nothing by rule."""
    depth = prefix_depth(threshold, recall, trees, depth)
    hashes = trees * depth
    test = (trees, agreement_floor(hashes, threshold), threshold)
    every = materialise(_text_rows(docs, id_col, text_col, hashes, row_col=row_col), "forest-documents")
    texts = materialise(every.where("grams > 0 and doc_id is not null").groupBy("tid", "grams").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("data").alias("data")), "forest-texts")
    nodes = _leaves(texts, _crowds(texts, trees, depth, crowd), trees, depth)
    place = F.posexplode("nodes").alias("tree", "node")
    shared = nodes.select(place).groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1")
    members = nodes.select("tid", "copies", "grams", "names", "sketch", place).join(shared, ["tree", "node"])
    tiled = _tiles(members, tile).selectExpr(*[c.split(" ")[0] for c in _MEMBER.split(", ")])
    wanted = materialise(in_arrow(_dealt(tiled), _candidate_kernel(*test), _MEMBER), "forest-candidates")
    asked = wanted.select("tid").distinct().join(texts.select("tid", "rep"), "tid").select(F.col("rep").alias(id_col)).distinct()
    sets = (_text_rows(docs.select(id_col, text_col).join(asked, id_col, "left_semi"), id_col, text_col, 0, with_sets=True)
            .groupBy("tid").agg(F.min("data").alias("set")))
    found = in_arrow(_dealt(wanted.join(sets, "tid")), _verify_kernel(*test), "tid long, links long, to long")
    found = materialise(found, "forest-links")
    labels = components(found, "tid", "to").withColumnRenamed("node", "tid")
    linked = (texts.select("tid", "rep", "copies").join(found.groupBy("tid").agg(F.sum("links").alias("links")), "tid", "left")
              .join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid")))
    smallest = linked.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = salted_join(linked, smallest, "label", "tid", "inner").select(
        "tid", "label", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    keyed = every.select("row", "doc_id", "tid", "grams")
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull() | (F.col("grams") == 0)
    return (salted_join(keyed, classes, "tid", "doc_id", "left")
            .select("row", "doc_id", F.when(~alone, F.col("label")).alias("label"),
                    F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """``doc_id, class_id, n_links`` per document."""
    return _classed(docs, id_col, text_col, threshold, recall, trees, depth, tile, crowd).select("doc_id", "class_id", "n_links")


def first_of_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, of those with its smallest id. Documents without an id or words stay. Rows
    are told apart by a written row number, so repeated ids and rows are judged one by one."""
    place = {c: f"_doc.c{i}" for i, c in enumerate(docs.columns)}       # the user's row is one struct: no name of it is met
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), row.alias("_doc")), "forest-numbered")
    plain = numbered.select("_row", F.col(place[id_col]).alias("doc_id"), F.col(place[text_col]).alias("text"))
    classed = _classed(plain, "doc_id", "text", THRESHOLD, RECALL, TREES, DEPTH, TILE, row_col="_row")
    classed = materialise(classed.select("row", "doc_id", "label"), "forest-classed")
    first = (classed.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"))
             .select("first.row"))
    kept = classed.where("label is null").select("row").union(first).withColumnRenamed("row", "_row")
    left = numbered.join(materialise(kept, "forest-kept"), "_row", "left_semi")
    return left.select(*(F.col(place[c]).alias(c) for c in docs.columns))
