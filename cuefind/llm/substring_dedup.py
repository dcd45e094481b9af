"""Removal of repeated word sequences by fixed-block anchors.

A window is ``WINDOW`` consecutive words. A window whose words also start earlier (smaller id, or
same document, earlier start) is a repeat; every word that a repeat covers goes. Windows are
judged on the input.

1. *Anchors.* Every document is cut into non-overlapping reference blocks of ``BLOCK`` words; a
   window of twice that length holds at least one whole block, wherever it starts. The blocks are
   indexed by hash and probed by every rolling window of ``BLOCK`` words of all documents. A block
   that no other place matches takes no part in any repeat.
2. *Extension.* A window can only be a repeat, or have one, if all blocks inside it were hit. The
   hashes (96 bits) of these windows are compared over all documents; of equal ones, the earliest
   stays. Runs of such windows are the maximal exact repeats.
3. *Removal.* Words covered by the others are dropped.

Both comparisons are dealt by hash, as packed arrays per task and bucket: four bytes for a probe.
What a task can decide alone is decided there, and it sends each hash only once, so a passage in a
third of all documents reaches its bucket once per task instead of once per document. A short probe
hash can only add candidates for step 2. The texts are shuffled once; both passes over them read
the same exchange (in ``clean`` with the other columns as one struct; each text is in it once). Nothing
is emitted per pair of places.

A document travels under a 64-bit hash of its id and text. Documents that share one by chance meet in
one chunk of texts, where they get different keys (``_keys``), so none is cut by another's repeats.

Cases: a null text has no words, an empty one neither; a text shorter than a window stays whole;
a null id counts as the smallest; rows that repeat id and text are the same document and are not
earlier than each other; rows with one id but other texts are compared by (id, start) alike; an empty
table gives no rows; texts of any length are read whole; other columns, whatever their names, pass
through ``clean`` untouched and are not read by ``rows``.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from cuefind.llm.common import WORD_GAP, in_arrow, per_group, split_words, text_slices
from cuefind.session import ship_package

WINDOW = 20
BLOCK = WINDOW // 2
#: Words that a task compares alone before it sends hashes on; text bytes of a bucket or chunk.
FLUSH_WORDS = 1 << 20
BUCKET_BYTES = 8 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).min


def _rolling(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` values (polynomial in 2^64, then mixed)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= _MULTIPLIER
        out += h[k:k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """First places of equal runs."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash by its leading bits: contiguous in hash order."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian numbers, first bytes first: sorted numbers compress well so."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def _split(order_key: np.ndarray, parts: int):
    """(part, slice) of a sorted array of part numbers."""
    cut = np.searchsorted(order_key, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), slice(int(cut[p]), int(cut[p + 1]))


def _chunk(doc: np.ndarray, chunks: int) -> np.ndarray:
    return (doc.astype(np.int64) % chunks).astype(np.int64)


# ---- 1. anchors ---------------------------------------------------------------------------------

#: One row per task and bucket: probe hashes; index hashes with document and block; hits known already.
_ANCHORS = "bucket long, probe binary, own binary, doc binary, block binary, hit_doc binary, hit_block binary"
_HITS = "_chunk long, doc binary, block binary"


def _anchor_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int):
    """Hash every rolling window of some documents; settle what they settle among themselves."""
    h, doc, pos = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    h, doc, pos = h[order], doc[order], pos[order]
    aligned = pos % BLOCK == 0
    first = _groups(h)
    size = np.diff(np.r_[first, len(h)])
    twice = np.repeat(size > 1, size)
    local = aligned & twice                             # hit by a window of the same task
    own = aligned & ~twice                              # to be probed by the other tasks
    probe = h[first][(size > 1) | ~aligned[first]]
    per_bucket: dict[int, list] = {}
    low = lambda x: (x >> np.uint64(8)).astype(np.uint32)
    for b, s in _split(_buckets(probe, buckets), buckets):
        per_bucket.setdefault(b, [b""] * 6)[0] = _planes(low(probe[s]), 4)
    oh, od, op = h[own], doc[own], pos[own] // BLOCK
    for b, s in _split(_buckets(oh, buckets), buckets):
        row = per_bucket.setdefault(b, [b""] * 6)
        row[1], row[2], row[3] = _planes(low(oh[s]), 4), od[s].tobytes(), _planes(op[s], 4)
    if local.any():
        row = per_bucket.setdefault(int(doc[local][0] % buckets), [b""] * 6)
        row[4], row[5] = doc[local].tobytes(), _planes(pos[local] // BLOCK, 4)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(per_bucket), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*per_bucket.values()))],
        ["bucket", "probe", "own", "doc", "block", "hit_doc", "hit_block"])


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def kernel(batches):
        parts, words_held = [], 0
        for rb in text_slices(batches, "_text"):
            words = split_words(rb.column("_text"))
            h = _rolling(words.hashes(1), BLOCK)
            owner, n = words.owner(), words.counts
            place = np.arange(len(words.codes)) - words.start[:-1][owner]
            fits = (place[:len(h)] + BLOCK <= n[owner[:len(h)]]) & (n[owner[:len(h)]] >= WINDOW)
            if fits.any():
                doc = rb.column("_doc").to_numpy().astype(np.int64)
                at = np.flatnonzero(fits)
                parts.append((h[at], doc[owner[at]], place[at]))
                words_held += len(at)
            if words_held >= FLUSH_WORDS:
                yield from _anchor_rows(parts, buckets)
                parts, words_held = [], 0
        if parts:
            yield from _anchor_rows(parts, buckets)

    return in_arrow(docs.select("_doc", "_text"), kernel, _ANCHORS)


def _probe_bucket(chunks: int):
    """All tasks' probes and index blocks of one bucket: the blocks that are hit."""
    def join(table: pa.Table) -> pa.Table:
        col = lambda name: [x for x in table.column(name).to_pylist() if x]
        probe = [_from_planes(x, 4) for x in col("probe")]
        own = [_from_planes(x, 4) for x in col("own")]
        doc = [np.frombuffer(x, np.int64) for x in col("doc")]
        block = [_from_planes(x, 4) for x in col("block")]
        h = np.concatenate([*own, *probe]) if own or probe else np.zeros(0, np.uint32)
        n_own = sum(map(len, own))
        order = np.argsort(h, kind="stable")
        first = _groups(h[order])
        size = np.diff(np.r_[first, len(h)])
        met = np.zeros(len(h), bool)
        met[order] = np.repeat(size > 1, size)
        hit = met[:n_own]
        doc = np.concatenate([*(doc or [np.zeros(0, np.int64)])])[hit]
        block = np.concatenate([*(block or [np.zeros(0, np.uint32)])])[hit]
        doc = np.concatenate([doc, *(np.frombuffer(x, np.int64) for x in col("hit_doc"))])
        block = np.concatenate([block, *(_from_planes(x, 4) for x in col("hit_block"))])
        return _by_chunk(doc, block, chunks, "block")
    return join


def _by_chunk(doc: np.ndarray, number: np.ndarray, chunks: int, name: str) -> pa.Table:
    """(document, number) pairs as one packed row per chunk, in order."""
    chunk = _chunk(doc, chunks)
    order = np.lexsort((number, doc, chunk))
    chunk, doc, number = chunk[order], doc[order], number[order]
    rows = [(c, doc[s].tobytes(), _planes(number[s], 4)) for c, s in _split(chunk, chunks)]
    c, d, x = zip(*rows) if rows else ((), (), ())
    return pa.table({"_chunk": pa.array(c, pa.int64()), "doc": pa.array(d, pa.binary()), name: pa.array(x, pa.binary())})


def _pairs(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed pairs of a chunk, sorted by document."""
    doc = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist())])
    number = np.concatenate([np.zeros(0, np.uint32), *(_from_planes(x, 4) for x in table.column(name).to_pylist())])
    order = np.argsort(doc, kind="stable")
    return doc[order], number[order].astype(np.int64)


def _marks(docs: np.ndarray, length: np.ndarray, pair_doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A flag per document and number below ``length``: (flags, start of each document's flags)."""
    start = np.concatenate([[0], np.cumsum(length)])
    flags = np.zeros(start[-1], bool)
    a, b = np.searchsorted(pair_doc, docs, "left"), np.searchsorted(pair_doc, docs, "right")
    count = b - a
    row = np.repeat(np.arange(len(docs)), count)
    pick = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + a[row]
    ok = number[pick] < length[row]
    flags[start[row[ok]] + number[pick[ok]]] = True
    return flags, start


def _keys(texts: pa.Table, chunks: int) -> np.ndarray:
    """A key per row of a chunk: its ``_doc``, but of different documents with one ``_doc`` all but the first
    move on, within the chunk, to a free one. The same in every pass over the chunk."""
    doc = texts.column("_doc").to_numpy().astype(np.int64)
    keys, size = np.unique(doc, return_counts=True)
    if (size == 1).all():
        return doc
    doc, taken = doc.copy(), set(keys.tolist())
    several = np.flatnonzero(np.isin(doc, keys[size > 1]))
    rows = texts.select(["_id", "_text"]).take(pa.array(several))
    found: dict[int, dict] = {}
    for at, value in zip(several.tolist(), zip(rows.column("_id").to_pylist(), rows.column("_text").to_pylist())):
        found.setdefault(int(doc[at]), {}).setdefault(value, []).append(at)
    for key in sorted(k for k, same in found.items() if len(same) > 1):
        for value in sorted(found[key], key=repr)[1:]:
            new, step = key, chunks if key < 0 else -chunks
            while new in taken:
                new += step
            taken.add(new)
            doc[found[key][value]] = new
    return doc


def _keyed(texts: pa.Table, chunks: int) -> pa.Table:
    at = texts.schema.get_field_index("_doc")
    return texts.set_column(at, "_doc", pa.array(_keys(texts, chunks), pa.int64())) if texts.num_rows else texts


# ---- 2. extension -------------------------------------------------------------------------------

#: One row per chunk and bucket: window hashes, the place of each; documents as (key, id) pairs;
#: or, as (gone_doc, gone_pos), repeats that a chunk has settled alone.
_WINDOWS = "bucket long, h binary, g binary, at binary, pos binary, docs binary, ids binary, gone_doc binary, gone_pos binary"


def _extend_chunk(buckets: int):
    def cogroup(texts: pa.Table, hits: pa.Table) -> pa.Table:
        hit_doc, block = _pairs(hits, "block")
        found: list[tuple] = []
        texts = texts.select(["_doc", "_id", "_text"])
        key, doc = _keys(texts, buckets), texts.column("_doc").to_numpy()
        moved = set(zip(key[key != doc].tolist(), doc[key != doc].tolist()))
        if moved:                                           # a hit under a shared hash may be of any of them
            also = [(np.full(int(s.sum()), k), block[s]) for k, d in sorted(moved) for s in [hit_doc == d]]
            hit_doc, block = np.concatenate([hit_doc, *(k for k, _ in also)]), np.concatenate([block, *(x for _, x in also)])
            order = np.argsort(hit_doc, kind="stable")
            hit_doc, block = hit_doc[order], block[order]
        texts = texts.set_column(0, "_doc", pa.array(key, pa.int64()))
        wanted = texts.filter(pc.is_in(texts.column("_doc"), value_set=pa.array(np.unique(hit_doc), pa.int64())))
        for rb in text_slices(wanted.combine_chunks().to_batches(), "_text"):
            words = split_words(rb.column("_text"))
            n, owner = words.counts, words.owner()
            doc = rb.column("_doc").to_numpy().astype(np.int64)
            ids = pc.fill_null(rb.column("_id"), _NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            flags, start = _marks(doc, n // BLOCK, hit_doc, block)
            windows = max(len(words.codes) - WINDOW + 1, 0)
            own = owner[:windows]
            place = np.arange(windows) - words.start[own]
            fits = place + WINDOW <= n[own]
            at = np.flatnonzero(fits)
            low, high = (place[at] + BLOCK - 1) // BLOCK, (place[at] + WINDOW) // BLOCK - 1
            at = at[flags[start[own[at]] + low] & flags[start[own[at]] + high]]
            if len(at):
                h, g = _rolling(words.hashes(2), WINDOW)[at], _rolling(words.hashes(3), WINDOW)[at]
                found.append((h, (g >> np.uint64(32)).astype(np.uint32), doc[own[at]], ids[own[at]], place[at]))
        if not found:
            return _WINDOW_SCHEMA.empty_table()
        h, g, doc, ids, pos = (np.concatenate(x) for x in zip(*found))
        first, gone = _earliest(h, g, doc, ids, pos)
        h, g, doc, ids, pos, gone_doc, gone_pos = h[first], g[first], doc[first], ids[first], pos[first], doc[gone], pos[gone]
        rows = []
        for b, s in _split(_buckets(h, buckets), buckets):
            keys, back = np.unique(doc[s], return_index=True)
            rows.append((b, h[s].tobytes(), g[s].tobytes(), np.searchsorted(keys, doc[s]).astype(np.uint32).tobytes(),
                         _planes(pos[s], 4), keys.tobytes(), ids[s][back].tobytes(), b"", b""))
        if len(gone_doc):
            rows.append((int(abs(int(gone_doc[0])) % buckets), *[b""] * 6, gone_doc.tobytes(), _planes(gone_pos, 4)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _WINDOW_SCHEMA.types)], schema=_WINDOW_SCHEMA)
    return cogroup


_WINDOW_SCHEMA = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in
                            ("h", "g", "at", "pos", "docs", "ids", "gone_doc", "gone_pos"))])


def _earliest(h, g, doc, ids, pos) -> tuple[np.ndarray, np.ndarray]:
    """Of equal windows: places of the earliest (all with its id and start, once per document),
    in hash order, and places of the others."""
    order = np.lexsort((doc, pos, ids, g, h))
    first = _groups(h[order], g[order])
    size = np.diff(np.r_[first, len(h)])
    lead = np.repeat(order[first], size)
    early = (ids[order] == ids[lead]) & (pos[order] == pos[lead])
    same = np.r_[False, (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1])
                 & (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])]
    return order[early & ~same], order[~early]


def _window_bucket(chunks: int):
    """All chunks' windows of one bucket: the places that repeat an earlier one."""
    def join(table: pa.Table) -> pa.Table:
        rows = [r for r in zip(*(table.column(x).to_pylist() for x in ("h", "g", "at", "pos", "docs", "ids"))) if r[0]]
        gone_doc = [np.frombuffer(x, np.int64) for x in table.column("gone_doc").to_pylist() if x]
        gone_pos = [_from_planes(x, 4) for x in table.column("gone_pos").to_pylist() if x]
        if rows:
            at = [np.frombuffer(r[2], np.uint32) for r in rows]
            h = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            g = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
            pos = np.concatenate([_from_planes(r[3], 4) for r in rows])
            doc = np.concatenate([np.frombuffer(r[4], np.int64)[a] for r, a in zip(rows, at)])
            ids = np.concatenate([np.frombuffer(r[5], np.int64)[a] for r, a in zip(rows, at)])
            _, gone = _earliest(h, g, doc, ids, pos)
            gone_doc.append(doc[gone])
            gone_pos.append(pos[gone])
        return _by_chunk(np.concatenate([np.zeros(0, np.int64), *gone_doc]),
                         np.concatenate([np.zeros(0, np.uint32), *gone_pos]), chunks, "pos")
    return join


# ---- 3. removal ---------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _covered(table: pa.RecordBatch, words: np.ndarray, gone_doc: np.ndarray, gone_pos: np.ndarray):
    """Per word of each document: does a repeat cover it?"""
    flags, start = _marks(table.column("_doc").to_numpy().astype(np.int64), words, gone_doc, gone_pos)
    step = np.zeros(len(flags) + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)                    # a window ends inside its document
    return np.cumsum(step[:-1]) > 0, start


def _plain(texts: pa.Array) -> pa.Array:
    """Words joined by one blank."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=WORD_GAP, replacement=" "), characters=" ")


def _digest_rows(chunks: int):
    return lambda texts, gone: _digest_chunk(_keyed(texts, chunks), gone)


def _digest_chunk(texts: pa.Table, gone: pa.Table) -> pa.Table:
    gone_doc, gone_pos = _pairs(gone, "pos")
    out = []
    for rb in text_slices(texts.combine_chunks().to_batches(), "_text"):
        plain = _plain(rb.column("_text")).to_pylist()
        n = np.array([t.count(" ") + 1 if t else 0 for t in plain], np.int64)
        covered, start = _covered(rb, n, gone_doc, gone_pos)
        for i, (doc, text) in enumerate(zip(rb.column("_id").to_pylist(), plain)):
            cut = covered[start[i]:start[i + 1]]
            removed = int(cut.sum())
            if removed:
                text = " ".join(itertools.compress(text.split(" "), ~cut))
            out.append((doc, int(n[i]), removed, hashlib.sha256(text.encode()).hexdigest()))
    cols = zip(*out) if out else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _clean_rows(chunks: int):
    """Documents with their kept words: the runs between removed words, as they were, joined by a blank."""
    def cogroup(texts: pa.Table, gone: pa.Table) -> pa.Table:
        gone_doc, gone_pos = _pairs(gone, "pos")
        touched = pa.array(np.unique(gone_doc), pa.int64())
        out = []
        for rb in text_slices(_keyed(texts, chunks).combine_chunks().to_batches(), "_text"):
            text = rb.column("_text")
            rows = np.flatnonzero(pc.is_in(rb.column("_doc"), value_set=touched).to_numpy(zero_copy_only=False))
            if len(rows):
                values = text.to_pylist()
                for i in rows.tolist():
                    spans = [m.span() for m in _WORD.finditer(values[i] or "")]
                    cut, _ = _covered(rb.slice(i, 1), np.array([len(spans)]), gone_doc, gone_pos)
                    runs = (list(g) for dropped, g in itertools.groupby(range(len(spans)), lambda k: cut[k]) if not dropped)  # noqa: B023
                    values[i] = " ".join(values[i][spans[r[0]][0]:spans[r[-1]][1]] for r in runs) if cut.any() else values[i]
                text = pa.array(values, pa.string())
            out.append(pa.RecordBatch.from_arrays([rb.column("_row"), text.cast(pa.string())], ["_row", "_text"]))
        schema = pa.schema([texts.schema.field("_row"), ("_text", pa.string())])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()
    return cogroup


def _run(docs: DataFrame, id_col: str, text_col: str, last, schema, kept: list) -> DataFrame:
    ship_package(docs.sparkSession)
    base = docs.select(*kept, docs[f"`{id_col}`"].cast("long").alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"))
    base = base.withColumn("_doc", F.xxhash64("_id", "_text"))
    size = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = int(max(32, size // BUCKET_BYTES))
    texts = base.withColumn("_chunk", F.pmod("_doc", F.lit(parts)))
    hits = _anchors(base, parts).groupBy("bucket").applyInArrow(per_group(_probe_bucket(parts)), _HITS)
    windows = (texts.groupBy("_chunk").cogroup(hits.groupBy("_chunk"))
               .applyInArrow(per_group(_extend_chunk(parts)), _WINDOWS))
    gone = windows.groupBy("bucket").applyInArrow(per_group(_window_bucket(parts)), "_chunk long, doc binary, pos binary")
    return texts.groupBy("_chunk").cogroup(gone.groupBy("_chunk")).applyInArrow(per_group(last(parts)), schema)


def rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest rows of ``op3``: ``doc_id, n_words, n_removed, kept_sha256`` per document."""
    return _run(docs, id_col, text_col, _digest_rows,
                "doc_id long, n_words long, n_removed long, kept_sha256 string", [])


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with their repeats cut out of the text (and ``chars_col``, if there, brought in line).
    The columns beside the text travel as one struct, whose fields are numbered: no name of theirs is met."""
    place = {c: i for i, c in enumerate(docs.columns)}
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{place[c]}") for c in others), F.lit(None).cast("int").alias("none")).alias("_row")
    types = {f.name: f.dataType for f in docs.schema}
    fields = StructType([*(StructField(f"c{place[c]}", types[c], docs.schema[c].nullable) for c in others),
                         StructField("none", IntegerType())])
    out = _run(docs, id_col, text_col, _clean_rows, StructType([StructField("_row", fields), StructField("_text", StringType())]), [row])
    new = {text_col: F.col("_text").cast(types[text_col])}
    if chars_col in place and chars_col != text_col:
        new[chars_col] = F.length("_text").cast(types[chars_col])
    return out.select(*(new.get(c, F.col(f"_row.c{place[c]}")).alias(c) for c in docs.columns))
