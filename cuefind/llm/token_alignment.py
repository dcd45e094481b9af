"""Alignment of two tokenizers: which tokens of A and B cover the same bytes, and how often in the corpus.

Both tokenizers read a blank and the text (A a byte-level BPE file, B a SentencePiece file that adds the
blank itself; strings of special tokens are plain text). Byte offsets where tokens of both end cut the
text into groups; every A token of a group is linked to every B token of it. A pair's count is the number
of documents that hold it linked.

Counting is by minimal perfect hashing of the distinct pairs:

1. *Pairs.* The texts are dealt to slices. A slice aligns its texts and keeps each pair once, with its
   documents. Pairs are dealt by their A id to ``SHARDS`` shards; a tree of unions (``FAN`` slices to a node)
   leaves the distinct pairs of each shard.
2. *Hash.* A shard's pairs get a minimal perfect hash (``PairHash``: bit levels and ranks, under four bits a
   pair) and a list of the pairs in hash order, against which every look-up is verified.
3. *Counts.* Each node turns its slices' pairs into one dense vector, indexed by the hash; the vectors are summed
   up the same tree. A shard then knows the counts of its pairs and the highest count of each A id.
4. *Second pass.* The nodes look up their slices' pairs, and every slice aligns its texts again and adds up.

No group is unbounded: a slice is about ``SLICE_TEXT`` bytes (or one longer text), a node ``FAN`` slices, a shard
is bounded by the two vocabularies. Nothing is broadcast or collected. Rows are dealt by their place in
the input, so any number of equal rows spreads; the input must read the same when read again, as a table does.

Tokens never cross a place where a blank follows something that is no white space, in either vocabulary
(checked when it is loaded). So texts are cut there, and each distinct piece of a slice is encoded once.

Cases: texts that are null or empty, or whose tokens' bytes differ from the blank and the text, have no tokens:
zeros and an empty string, unhashed; equal rows count as documents each; ids may be null or repeat; texts of any
length are encoded whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefind.llm.bpe import PATTERN, byte_chars, vocabulary_path
from cuefind.llm.common import per_group, segment_sum, spread, text_slices
from cuefind.session import ship_package

SLICE_TEXT = 8 << 20
SHARDS = 64
FAN = 64
#: Characters of a chunk that is encoded by itself.
LONG_CHUNK = 2000
_B_BITS = 16
_CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: the character that SentencePiece writes for a blank.
_BLANK = "▁"


class Vocabularies:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{a_path} is not a plain byte-level BPE vocabulary")
        chars = byte_chars()
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        # ids in the order of the merges are ranks: then the faster library gives the same ids
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            bytes(map(chars.get, t)): i for t, i in spec["model"]["vocab"].items()}) if made == sorted(made) else None
        vocab = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces) or len(pieces) >= 1 << _B_BITS:
            raise ValueError(f"{b_path} has pieces that go on after a blank, or too many")
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(_BLANK)
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.size = [np.array([len(x) for x in xs], np.int64) for xs in (a_bytes, b_bytes)]
        self.decimal = [pa.array([str(i) for i in range(len(xs))]) for xs in (a_bytes, b_bytes)]

    def encode(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the chunks (each begins with a blank) and the first id's place of each, for A and B."""
        of_b = self.b.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
        of_b = [ids if c != " " else [self.blank] for c, ids in zip(chunks, of_b)]
        return [self._encode_a(chunks), _flat(of_b)]

    def _encode_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that end in no white space are encoded as one text, whose tokens end where chunks do."""
        apart = [self.fast is None or c[-1].isspace() or len(c) > LONG_CHUNK for c in chunks]
        together = [c for c, x in zip(chunks, apart) if not x]
        ids = self.fast.encode_to_numpy("".join(together), disallowed_special=()).astype(np.int64) if together else np.zeros(0, np.int64)
        ends = np.cumsum([len(c.encode()) for c in together])
        stop = np.searchsorted(np.cumsum(self.size[0][ids]), ends, "right")
        start = np.concatenate([[0], stop])
        if not any(apart):
            return ids, start
        others = _flat([e.ids for e in self.a.encode_batch_fast([c for c, x in zip(chunks, apart) if x], add_special_tokens=False)])
        size = np.empty(len(chunks), np.int64)
        apart = np.array(apart)
        size[apart], size[~apart] = np.diff(others[1]), np.diff(start)
        owner = np.repeat(apart, size)
        out = np.empty(len(owner), np.int64)
        out[owner], out[~owner] = others[0], ids
        return out, np.concatenate([[0], np.cumsum(size)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter(itertools.chain.from_iterable(lists), np.int64),
            np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order (sorted in place)."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@functools.lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> Vocabularies:
    """One pair of tokenizers per worker."""
    return Vocabularies(vocabulary_path(a), vocabulary_path(b))


@dataclass
class Aligned:
    """What is known of each distinct chunk. ``links``: the different pairs of its groups, with the number of
    links of each (``times``); those of chunk i at ``first[i]:first[i+1]``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    ok: np.ndarray
    groups: pa.Array
    links: np.ndarray
    times: np.ndarray
    first: np.ndarray


def _lists(start: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), values)


def align(v: Vocabularies, chunks: list[str], with_text: bool) -> Aligned:
    """Align every chunk with itself."""
    (a, a_start), (b, b_start) = v.encode(chunks)
    text = pa.array(chunks, pa.string()).cast(pa.binary())
    ok = np.ones(len(chunks), bool)
    ends = []
    for side, (ids, start) in enumerate(((a, a_start), (b, b_start))):
        joined = pc.binary_join(_lists(start, v.bytes[side].take(pa.array(ids))), b"")
        ok &= pc.equal(joined, text).to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(chunks)), np.diff(start))
        total = np.concatenate([[0], np.cumsum(v.size[side][ids])])
        ends.append((chunk << 32) + total[1:] - total[start[chunk]])        # chunk, bytes up to the token's end
    near = np.minimum(np.searchsorted(ends[1], ends[0]), max(len(ends[1]) - 1, 0))
    cuts = ends[0][ends[1][near] == ends[0]] if len(ends[1]) else ends[1]      # both are in order and without repeats
    if not ok.all():        # chunks that no cut ends are of no use: their texts have no tokens
        keep = [ok[e >> 32] for e in ends]
        a, b = a[keep[0]], b[keep[1]]
        a_start, b_start = (np.concatenate([[0], np.cumsum(np.where(ok, np.diff(s), 0))]) for s in (a_start, b_start))
        ends = [e[k] for e, k in zip(ends, keep)]
        cuts = cuts[ok[cuts >> 32]]
    group = [np.searchsorted(cuts, e) for e in ends]
    size = [np.bincount(g, minlength=len(cuts)) for g in group]
    begin = [np.concatenate([[0], np.cumsum(s)]) for s in size]
    of_chunk = np.concatenate([[0], np.cumsum(np.bincount(cuts >> 32, minlength=len(chunks)))])
    # a group's links by its different ids: a run without common ends may be long, its ids are few
    (ka, ta), (kb, tb) = (np.unique(g << 20 | ids, return_counts=True) for g, ids in zip(group, (a, b)))
    da, db = (np.concatenate([[0], np.cumsum(np.bincount(k >> 20, minlength=len(cuts)))]) for k in (ka, kb))
    n_pairs = np.diff(da) * np.diff(db)
    within = np.arange(int(n_pairs.sum())) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
    wide = np.repeat(np.diff(db), n_pairs)
    left, right = np.repeat(da[:-1], n_pairs) + within // wide, np.repeat(db[:-1], n_pairs) + within % wide
    links, times = (ka[left] & 0xFFFFF) << _B_BITS | kb[right] & 0xFFFFF, ta[left] * tb[right]
    groups = pa.array([""] * len(chunks))
    if with_text:
        sides = [pc.binary_join(_lists(bg, d.take(pa.array(ids))), ",") for bg, d, ids in zip(begin, v.decimal, (a, b))]
        groups = pc.binary_join(_lists(of_chunk, pc.binary_join_element_wise(*sides, "|")), ";")
    first = np.concatenate([[0], np.cumsum(n_pairs)])[of_chunk]
    n_links = segment_sum(size[0] * size[1], of_chunk)
    return Aligned(np.diff(a_start), np.diff(b_start), np.diff(of_chunk), n_links, ok, groups, links, times, first)


@dataclass
class Cut:
    """Texts as distinct chunks: ``chunk[codes]``, text ``row[i]`` at ``start[i]:start[i+1]``."""

    row: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    chunk: list[str]


def cut(texts: pa.Array) -> list[Cut]:
    """The texts that may have tokens, cut before blanks that follow something else: those with single blanks
    between words by one split, the others by a search."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    row = np.flatnonzero(pc.not_equal(texts, "").to_numpy(zero_copy_only=False))
    parts = pc.split_pattern(texts.take(pa.array(row)), " ")
    start = parts.offsets.to_numpy().astype(np.int64)
    start = start - start[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    open_end = np.array([not w or w[-1].isspace() for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    open_end[start[1:] - 1] = False                     # at a text's end nothing follows
    odd = segment_sum(open_end.astype(np.int64), start) > 0
    out = []
    if not odd.all():
        size = np.diff(start)
        used, codes = np.unique(codes[np.repeat(~odd, size)], return_inverse=True)
        out.append(Cut(row[~odd], codes, np.concatenate([[0], np.cumsum(size[~odd])]), [" " + words[i] for i in used]))
    if odd.any():
        found: dict[str, int] = {}
        pieces = [[found.setdefault(c, len(found)) for c in _CUT.split(" " + t)] for t in texts.take(pa.array(row[odd])).to_pylist()]
        out.append(Cut(row[odd], np.fromiter(itertools.chain.from_iterable(pieces), np.int64),
                       np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), list(found)))
    return out


# ---- minimal perfect hash ---------------------------------------------------------------------------

def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PairHash:
    """A minimal perfect hash of distinct keys: a key's place is the rank of its bit in the first level
    where no other key has its bit."""

    LOAD = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                    # of booleans
        self.ranks = []
        before = 0
        for bits in levels:
            rank = np.cumsum(bits) - 1 + before
            before += int(bits.sum())
            self.ranks.append(rank)
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        levels, rest = [], keys
        while len(rest):
            size = max(64, cls.LOAD * len(rest) + 7 & ~7)
            place = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            here = np.bincount(place, minlength=size) == 1
            levels.append(here)
            rest = rest[~here[place]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys (of those the hash was built for; of others any, or -1)."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(rest):
                break
            place = (_mixed(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PairHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at, levels = 8 * (n + 1), []
        for size in np.frombuffer(data, np.int64, n, 8).tolist():
            used = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, used, at))[:size].astype(bool))
            at += used
        return cls(levels)


def _places(table: dict, codes: np.ndarray) -> np.ndarray:
    """Places of pairs in a shard's hash order, each verified against the list of pairs."""
    keys = np.frombuffer(table["keys"], np.uint32)
    place = PairHash.unpack(table["hash"])(codes)
    if len(codes) and ((place < 0).any() or (keys[place] != codes).any()):
        raise ValueError("a pair is missing from the hash")
    return place


# ---- packed rows ------------------------------------------------------------------------------------

_PAIRS = "shard int, node int, slice int, codes binary, counts binary"
_UNION = "shard int, node int, codes binary"
_HASHES = "shard int, hash binary, keys binary"
_VECTORS = "shard int, node int, counts binary"
_TABLES = "shard int, hash binary, keys binary, counts binary, best binary"
_LOOKED_UP = "slice int, codes binary, counts binary, best binary"
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _out(schema: str, rows: list[tuple]) -> pa.Table:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types)], names=list(names))


def _shard(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) >> np.uint64(_B_BITS)) * np.uint64(2654435761) >> np.uint64(12)).astype(np.int64) % SHARDS


def _first(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def _slice_pairs(a: str, b: str):
    """Pass 1: each pair of a slice once, with the number of the slice's documents that hold it."""
    def kernel(texts: pa.Table) -> pa.Table:
        v, slice_no = vocabularies(a, b), _first(texts, "_slice")
        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rb in text_slices(texts.combine_chunks().to_batches(), "_text", SLICE_TEXT):
            for c in cut(rb.column("_text")):
                al = align(v, c.chunk, False)
                size = np.diff(c.start)
                fine = segment_sum((~al.ok[c.codes]).astype(np.int64), c.start) == 0
                doc = np.repeat(np.arange(len(size)), size)
                held = distinct((doc * len(c.chunk) + c.codes)[fine[doc]])
                doc, chunk = held // len(c.chunk), held % len(c.chunk)
                n = np.diff(al.first)[chunk]
                pairs = distinct((np.repeat(doc, n) << 32) | al.links[spread(al.first[chunk], n)]) & 0xFFFFFFFF
                code, count = np.unique(pairs, return_counts=True)
                codes.append(code)
                counts.append(count)
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(code)).astype(np.uint32)
        shard = _shard(code)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        return _out(_PAIRS, [(s, slice_no // FAN, slice_no, code[p].astype(np.uint32).tobytes(), count[p].tobytes())
                             for s in range(SHARDS) for p in [order[cuts[s]:cuts[s + 1]]] if len(p)])
    return kernel


def _union(table: pa.Table) -> np.ndarray:
    return distinct(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("codes").to_pylist()]))


def _join_node(table: pa.Table) -> pa.Table:
    return _out(_UNION, [(_first(table, "shard"), _first(table, "node") // FAN, _union(table).tobytes())])


def _hash_shard(table: pa.Table) -> pa.Table:
    codes = _union(table)
    found = PairHash.build(codes)
    keys = np.empty(len(codes), np.uint32)
    keys[found(codes)] = codes
    return _out(_HASHES, [(_first(table, "shard"), found.pack(), keys.tobytes())])


def _dense_vector(pairs: pa.Table, hashes: pa.Table) -> pa.Table:
    """A node's slices as one vector of counts in hash order."""
    if not pairs.num_rows:
        return _out(_VECTORS, [])
    table = hashes.slice(0, 1).to_pylist()[0]
    codes = np.concatenate([np.frombuffer(x, np.uint32) for x in pairs.column("codes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pairs.column("counts").to_pylist()])
    vector = np.bincount(_places(table, codes), counts, len(table["keys"]) // 4).astype(np.int64)
    return _out(_VECTORS, [(table["shard"], _first(pairs, "node") // FAN, vector.tobytes())])


def _vector_sum(table: pa.Table) -> np.ndarray:
    out = None
    for x in table.column("counts").to_pylist():
        more = np.frombuffer(x, np.int64)
        out = more.copy() if out is None else out + more
    return out


def _sum_node(table: pa.Table) -> pa.Table:
    return _out(_VECTORS, [(_first(table, "shard"), _first(table, "node") // FAN, _vector_sum(table).tobytes())])


def _finish_shard(vectors: pa.Table, hashes: pa.Table) -> pa.Table:
    """A shard's pairs with their counts, and whether a pair has the highest count of its A id."""
    table = hashes.slice(0, 1).to_pylist()[0]
    counts = _vector_sum(vectors)
    ids, back = np.unique(np.frombuffer(table["keys"], np.uint32) >> np.uint32(_B_BITS), return_inverse=True)
    highest = np.zeros(len(ids), np.int64)
    np.maximum.at(highest, back, counts)
    return _out(_TABLES, [(table["shard"], table["hash"], table["keys"], counts.tobytes(), (counts == highest[back]).tobytes())])


def _look_up(pairs: pa.Table, tables: pa.Table) -> pa.Table:
    if not pairs.num_rows:
        return _out(_LOOKED_UP, [])
    table = tables.slice(0, 1).to_pylist()[0]
    counts, best = np.frombuffer(table["counts"], np.int64), np.frombuffer(table["best"], bool)
    rows = []
    for slice_no, data in zip(pairs.column("slice").to_pylist(), pairs.column("codes").to_pylist()):
        place = _places(table, np.frombuffer(data, np.uint32))
        rows.append((slice_no, data, counts[place].tobytes(), best[place].tobytes()))
    return _out(_LOOKED_UP, rows)


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _second_pass(a: str, b: str, with_groups: bool):
    """Pass 2: align again, look the pairs up, add up per document."""
    schema = _ROWS + ", groups string" * with_groups

    def cogroup(texts: pa.Table, found: pa.Table) -> pa.Table:
        v = vocabularies(a, b)
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in found.column(name).to_pylist())])
        code, count, best = read("codes", np.uint32).astype(np.int64), read("counts", np.int64), read("best", bool)
        order = np.argsort(code)
        code, values = code[order], np.stack([best[order].astype(np.int64), count[order]], axis=1)
        out = []
        for rb in text_slices(texts.combine_chunks().to_batches(), "_text", SLICE_TEXT):
            numbers, text = np.zeros((rb.num_rows, 6), np.int64), [""] * rb.num_rows
            for c in cut(rb.column("_text")):
                al = align(v, c.chunk, True)
                at = np.minimum(np.searchsorted(code, al.links), max(len(code) - 1, 0))
                known = (code[at] == al.links) if len(code) else np.zeros(len(al.links), bool)
                of_link = values[at] * (known * al.times)[:, None] if len(code) else np.zeros((len(al.links), 2), np.int64)
                per_chunk = np.column_stack([al.n_a, al.n_b, al.n_groups, al.n_links, segment_sum(of_link, al.first), al.ok == 0,
                                             segment_sum((~known).astype(np.int64), al.first)])
                total = segment_sum(per_chunk[c.codes], c.start)
                fine = total[:, 6] == 0
                if (total[fine, 7] > 0).any():
                    raise ValueError("a pair of the second pass was not seen in the first")
                numbers[c.row[fine]] = total[fine, :6]
                joined = pc.binary_join(_lists(c.start, al.groups.take(pa.array(c.codes))), ";")
                for i, row in zip(np.flatnonzero(fine).tolist(), c.row[fine].tolist()):
                    text[row] = joined[i].as_py()
            sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
            out.append(pa.Table.from_arrays([rb.column("_id"), *(pa.array(x) for x in numbers.T), pa.array(sha, pa.string()),
                                             *([pa.array(text, pa.string())] if with_groups else [])],
                                            names=[f.split()[0] for f in schema.split(", ")]))
        return pa.concat_tables(out) if out else _out(schema, [])
    return schema, cogroup


# ---- the job ----------------------------------------------------------------------------------------

def _tree(rows: DataFrame, nodes: int, kernel, schema: str) -> DataFrame:
    """Join ``FAN`` nodes of a shard to one until one is left."""
    while nodes > 1:
        rows = rows.groupBy("shard", "node").applyInArrow(per_group(kernel), schema)
        nodes = -(-nodes // FAN)
    return rows


def _each_node(rows: DataFrame, nodes: int) -> DataFrame:
    return rows.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    text = docs[f"`{text_col}`"].cast("string")
    base = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), text.alias("_text"))
    size = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = int(max(32, size // SLICE_TEXT))
    return base.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), parts


def _counted(texts: DataFrame, parts: int, a: str, b: str) -> tuple[DataFrame, DataFrame, int]:
    """The slices' pairs, and the shards' tables of counts."""
    nodes = -(-parts // FAN)
    key = ["shard", "node"]
    pairs = texts.groupBy("_slice").applyInArrow(per_group(_slice_pairs(a, b)), _PAIRS)
    joined = pairs.groupBy(*key).applyInArrow(per_group(_join_node), _UNION)
    hashes = _tree(joined, nodes, _join_node, _UNION).groupBy("shard").applyInArrow(per_group(_hash_shard), _HASHES)
    vectors = pairs.groupBy(*key).cogroup(_each_node(hashes, nodes).groupBy(*key)).applyInArrow(per_group(_dense_vector), _VECTORS)
    vectors = _tree(vectors, nodes, _sum_node, _VECTORS)
    tables = vectors.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(per_group(_finish_shard), _TABLES)
    return pairs, tables, nodes


def pair_counts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``a_id, b_id, n_docs, best`` of every pair of the corpus."""
    ship_package(docs.sparkSession)
    texts, parts = _dealt(docs, id_col, text_col)
    _, tables, _ = _counted(texts, parts, a, b)

    def unpack(table: pa.Table) -> pa.Table:
        r = table.slice(0, 1).to_pylist()[0]
        keys = np.frombuffer(r["keys"], np.uint32).astype(np.int64)
        return pa.table({"a_id": pa.array((keys >> _B_BITS).astype(np.int32)), "b_id": pa.array((keys & (1 << _B_BITS) - 1).astype(np.int32)),
                         "n_docs": pa.array(np.frombuffer(r["counts"], np.int64)), "best": pa.array(np.frombuffer(r["best"], bool))})
    return tables.groupBy("shard").applyInArrow(per_group(unpack), "a_id int, b_id int, n_docs long, best boolean")


def rows(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", *, id_col: str = "doc_id",
         text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The rows of ``op13`` per document; ``with_groups`` adds the alignment itself (``a1,a2|b1;a3|b2,b3``)."""
    ship_package(docs.sparkSession)
    texts, parts = _dealt(docs, id_col, text_col)
    pairs, tables, nodes = _counted(texts, parts, a, b)
    key = ["shard", "node"]
    found = pairs.groupBy(*key).cogroup(_each_node(tables, nodes).groupBy(*key)).applyInArrow(per_group(_look_up), _LOOKED_UP)
    schema, kernel = _second_pass(a, b, with_groups)
    return texts.groupBy("_slice").cogroup(found.groupBy("slice")).applyInArrow(per_group(kernel), schema)
