"""Packing by deficit round-robin over source queues.

Documents wait in one queue per source. In every round (one window of sequences) each source is
credited its share of the window's tokens and sends whole documents while its credit lasts; what
it lacks or has left is carried to the next round. A document is therefore sent in the round in
which its source's credit first reaches the queue's tokens up to its end, which is a closed form
of its place in the queue: running sums in Spark, no serial walk, and deficits carry across
windows and partitions alike. Shares are the sources' shares of all tokens, or given weights.

The rounds' documents, one after another, are cut every ``SEQUENCE`` tokens. All sequences are
full except the last one; documents are only cut at sequence ends.

Running sums have two levels (sums per block, then inside a block), so a source with a third of
all rows is many window groups. The texts are read once: ids go to a table in the shared folder,
two bytes each where the vocabulary allows, and the order is worked out on their counts alone.

Cases: a null or empty text is just its end token; null or repeated ids and sources are packed
row by row (a null source is a source of its own); an empty table gives no rows; texts of any
length are encoded whole; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuefind.llm.bpe import CACHE_CHARS, byte_chars, vocabulary_path
from cuefind.llm.common import in_arrow, materialise, salted_join, spread, text_slices

SEQUENCE = 4096
END_ID = 2
WINDOW_SEQUENCES = 64
_CACHE_WORDS = 1 << 18
_SLICE_BYTES = 4 << 20
#: One mark after a word, and a word of Latin letters with at most one such mark.
_MARKS = ".,;:!?"
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"


class WordTokenizer:
    """Ids by the tokenizers library, once per distinct word of a slice.

    The vocabulary's splitting never joins what blanks and line breaks part, so a text's ids are
    those of its parts in a row. A part of Latin letters and at most one mark after them is lower-cased
    and merged by the library's model alone; every other part takes the library's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")        # Spark runs one task per core
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.model = self.full.model
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_others: dict[str, tuple[int, ...]] = {}
        self.kind = np.uint16 if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        shown = {b: c for c, b in byte_chars().items()}
        self.latin = str.maketrans({chr(x): "".join(shown[b] for b in chr(x).encode()) for x in range(0xC0, 0x100)})
        self.marks = {m: self.full.encode(m, add_special_tokens=False).ids for m in _MARKS}

    def _stems(self, stems: list[str]) -> list[tuple[int, ...]]:
        known, out = self.known, []
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in stems:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple([t.id for t in self.model.tokenize(w.translate(self.latin))])
            out.append(ids)
        return out

    def _others(self, parts: list[str]) -> list[tuple[int, ...]]:
        known = self.known_others
        if len(known) > _CACHE_WORDS:
            known.clear()
        new = [w for w in parts if w not in known]
        found = dict(zip(new, (tuple(e.ids) for e in self.full.encode_batch_fast(new, add_special_tokens=False))))
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_CHARS)
        return [found[w] if w in found else known[w] for w in parts]

    def _parts(self, vocab: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct parts, flat, and where each part's begin."""
        plain = pc.match_substring_regex(vocab, _PLAIN).to_numpy(zero_copy_only=False)
        size = np.zeros(len(vocab), np.int64)
        rest = np.flatnonzero(~plain)
        others = self._others(vocab.take(pa.array(rest)).to_pylist())
        size[rest] = [len(x) for x in others]
        words = vocab.take(pa.array(np.flatnonzero(plain)))
        coded = pc.utf8_lower(pc.utf8_rtrim(words, characters=_MARKS)).dictionary_encode()
        stem = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self._stems(coded.dictionary.to_pylist())
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(length.sum()))
        last = pc.utf8_slice_codeunits(words, start=-1)
        mark = pc.index_in(last, value_set=pa.array(list(_MARKS))).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        mark_ids = np.array([self.marks[m][0] for m in _MARKS], self.kind)
        size[plain] = length[stem] + (mark >= 0)
        start = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(start[-1]), self.kind)
        at = start[:-1][plain]
        out[spread(at, length[stem])] = flat[spread((np.cumsum(length) - length)[stem], length[stem])]
        out[at[mark >= 0] + length[stem][mark >= 0]] = mark_ids[mark[mark >= 0]]
        out[spread(start[:-1][rest], size[rest])] = np.fromiter(itertools.chain.from_iterable(others), self.kind, int(size[rest].sum()))
        return out, start

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text and the end id, as the narrowest integers."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        docs = parts.offsets.to_numpy().astype(np.int64)
        docs = docs - docs[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = self._parts(coded.dictionary)
        size = np.diff(start)[codes]
        ids = flat[spread(start[:-1][codes], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[docs]
        end = np.array([END_ID], self.kind)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(ends[:-1], ends[1:])]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_row, doc_id, source, doc_tokens, ids, width`` of every document, written once."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                         F.col(text_col).cast("string").alias("text"))

    def kernel(batches):
        t = _tokenizer(vocabulary_path(vocabulary))
        for rb in text_slices(batches, "text", _SLICE_BYTES):
            ids = t.encode(rb.column("text"))
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), rb.column("source"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(len(ids), np.dtype(t.kind).itemsize, np.int32))],
                ["doc_id", "source", "doc_tokens", "ids", "width"])

    kind = source.schema["doc_id"].dataType.simpleString()
    ids = in_arrow(source, kernel, f"doc_id {kind}, source string, doc_tokens long, ids binary, width int")
    return materialise(ids.withColumn("_row", F.monotonically_increasing_id()), "packing-ids")


def _before(df: DataFrame, value: str, group: list[str], block: str) -> DataFrame:
    """Per (group, block): the sum of ``value`` over the group's earlier blocks, as ``_base``."""
    over = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (df.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
            .select(*group, block, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base")))


def positions(ids: DataFrame, weights: dict[str, float] | None = None, *, sequence: int = SEQUENCE,
              window_sequences: int = WINDOW_SEQUENCES, block_rows: int = 10_000) -> DataFrame:
    """``_row, at`` (ids before the document in the packed stream, long), ``round``."""
    base = ids.select("_row", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_source"), "doc_tokens")
    rows = base.agg(F.count("*")).first()[0]
    shares = base.groupBy("_source").agg(F.sum("doc_tokens").alias("_all"))
    if weights is not None:
        given = F.create_map(*itertools.chain.from_iterable((F.lit("s" + k), F.lit(float(v))) for k, v in weights.items()))
        shares = shares.withColumn("_all", F.coalesce(F.element_at(given, F.col("_source")), F.lit(1e-9)))
    total = shares.agg(F.sum("_all")).first()[0] or 1
    credit = shares.select("_source", (F.col("_all") * F.lit(float(sequence * window_sequences)) / F.lit(float(total))).alias("_credit"))
    # the source's queue: blocks by a hash of the row, inside a block by row
    queued = base.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(rows // block_rows + 1)))
    inside = Window.partitionBy("_source", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (queued.withColumn("_upto", F.sum("doc_tokens").over(inside))
              .join(_before(queued, "doc_tokens", ["_source"], "_block"), ["_source", "_block"])
              .withColumn("_end", F.col("_base") + F.col("_upto")).drop("_base", "_upto", "_block"))
    sent = (salted_join(queued, credit, "_source", "_row", "inner")
            .withColumn("_due", F.col("_end") / F.col("_credit"))
            .withColumn("round", F.ceil("_due").cast("long")))
    sent = materialise(sent.select("_row", "_source", "doc_tokens", "_due", "round"), "packing-rounds")
    # the stream: rounds in order, in a round the sources take turns as their credit comes in
    rounds = sent.groupBy("round").agg(F.sum("doc_tokens").alias("_tokens")).withColumn("_era", F.expr("round div 4096"))
    eras = _before(rounds.withColumn("_one", F.lit(0)), "_tokens", ["_one"], "_era").drop("_one")   # rounds / 4096 rows
    earlier = Window.partitionBy("_era").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = (rounds.withColumn("_inera", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)))
              .join(eras, "_era").select("round", (F.col("_base") + F.col("_inera")).alias("_start")))
    within = Window.partitionBy("round").orderBy("_due", "_source", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return (sent.withColumn("_upto", F.sum("doc_tokens").over(within)).join(rounds, "round")
            .select("_row", (F.col("_start") + F.col("_upto") - F.col("doc_tokens")).alias("at"), "round"))


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", weights: dict[str, float] | None = None, *,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sequence: int = SEQUENCE,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source,
    round`` and, if asked, ``ids`` (little-endian unsigned 32-bit)."""
    encoded = tokenised(docs, vocabulary, id_col, text_col, source_col)
    placed = encoded.join(positions(encoded, weights, sequence=sequence), "_row")

    def kernel(batches):
        for rb in text_slices(batches, "ids"):
            at = rb.column("at").to_numpy()
            rows, cols, data = [], [], []
            for row, (g, raw, width) in enumerate(zip(at.tolist(), rb.column("ids").to_pylist(), rb.column("width").to_pylist())):
                ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4")
                for s in range(g // sequence, (g + len(ids) - 1) // sequence + 1):
                    a, b = max(0, s * sequence - g), min(len(ids), (s + 1) * sequence - g)
                    piece = ids[a:b].tobytes()
                    rows.append(row)
                    cols.append((a, b - a, zlib.crc32(piece), s, g + a - s * sequence))
                    data.append(piece if with_ids else None)
            if not rows:
                continue
            table = np.array(cols, np.int64)
            own = rb.select(["doc_id", "doc_tokens", "source", "round"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), *(pa.array(table[:, k]) for k in range(3)), own.column("doc_tokens"),
                 pa.array(table[:, 3]), pa.array(table[:, 4]), own.column("source"), own.column("round"),
                 *([pa.array(data, pa.binary())] if with_ids else [])],
                [*_PIECE, *(["ids"] if with_ids else [])])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_arrow(placed, kernel, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long, source string, round long" + (", ids binary" if with_ids else ""))


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "round"]


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence joined (little-endian unsigned 32-bit ids). Pieces of one
    sequence are told apart by their offsets; no pieces give no sequences; other columns are not read."""
    return (pieces.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))     # at most ``SEQUENCE`` pieces
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
