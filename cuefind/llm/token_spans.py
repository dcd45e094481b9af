"""Token counts per section: every document is encoded once, whole, with token spans.

The exact encoding (``bpe``) gives every token the span of characters it stands for. The spans
are interval-joined, inside the task that holds the text, to the document's sections (sorted,
disjoint character spans; by default its lines, each with its line break). A token that lies in
one section counts there. A token that crosses a boundary goes to the section with most of its
characters, the earlier one of equals; tokens outside all sections count under section -1. So the
counts of a document always add up to the length of its whole encoding, which encoding the
sections one by one would not give.

A token that holds only some bytes of a character spans that whole character, so several tokens
may share one.

Cases: null and empty texts have no sections and no rows; ids may be null or repeat (a row of
results for each row); a section without tokens has a row with 0; texts of any length are read
whole; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuefind.llm.bpe import SLICE_BYTES, Codec, Memo, codec, split_chunks, vocabulary_path
from cuefind.llm.common import in_arrow, spread, text_slices


def _spans(c: Codec, words: list[str]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Characters of some words of the pattern in a row; first and end character of each token."""
    text = "".join(words)
    stops = list(itertools.accumulate([c.size[i] for i in c.ids_of(words)], initial=0))
    if text.isascii():
        return len(text), tuple(stops[:-1]), tuple(stops[1:])
    char = [k for k, ch in enumerate(text) for _ in ch.encode()]          # of each byte
    return len(text), tuple([char[b] for b in stops[:-1]]), tuple([char[b - 1] + 1 for b in stops[1:]])


def span_memo(c: Codec) -> Memo:
    return Memo(c, lambda words: _spans(c, words))


def _special(part: str, _: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    return len(part), (0,), (len(part),)


def _joined(values: list) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Spans of several runs of words in a row."""
    if len(values) == 1:
        return values[0]
    at, first, end = 0, [], []
    for chars, f, e in values:
        first += [at + x for x in f]
        end += [at + x for x in e]
        at += chars
    return at, tuple(first), tuple(end)


def token_spans(c: Codec, memo: Memo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character spans of the tokens of all texts, in order, and where each text's tokens begin."""
    ch = split_chunks(texts)
    values = [_joined(c.value(x, memo, _special)) for x in ch.chunk]
    odd = {int(i): _joined(c.walk(texts[int(i)].as_py() or "", memo, _special)) for i in np.flatnonzero(ch.odd)}
    values += odd.values()                              # an odd text is one chunk of its own
    codes, at = np.insert(ch.codes, ch.start[list(odd)], len(ch.chunk) + np.arange(len(odd))), np.where(ch.odd, 1, np.diff(ch.start))
    start = np.concatenate([[0], np.cumsum(at)])
    chars, first, end = zip(*values) if values else ((), (), ())
    chars, size = np.array(chars, np.int64)[codes], np.fromiter(map(len, first), np.int64, len(first))
    flat = lambda x: np.fromiter(itertools.chain.from_iterable(x), np.int64, int(size.sum()))
    base = np.cumsum(chars) - chars
    base -= np.repeat(base[np.minimum(start[:-1], max(len(base) - 1, 0))], at) if len(base) else base
    pick = spread((np.cumsum(size) - size)[codes], size[codes])
    base = np.repeat(base, size[codes])
    tokens = np.concatenate([[0], np.cumsum(size[codes])])[start]
    return base + flat(first)[pick], base + flat(end)[pick], tokens


def line_sections(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of all texts, each with its line break, and where each text's lines begin."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    size = pc.utf8_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    last = np.zeros(len(size), bool)
    last[offsets[1:] - 1] = True
    size -= last                                        # no break after the last line
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = np.cumsum(size)
    end -= np.concatenate([[0], end])[offsets[:-1]][owner]
    real = size > 0                                     # nothing after a final break is no line
    return np.column_stack([end - size, end])[real], np.concatenate([[0], np.cumsum(real)])[offsets]


def allot(first: np.ndarray, end: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether the token crosses into another or outside."""
    if not len(sections):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    low, high = sections[:, 0], sections[:, 1]
    a = np.searchsorted(high, first, side="right")            # first section that reaches the token
    b = np.searchsorted(low, end, side="left") - 1            # last one that begins before its end
    section = np.where(a <= b, a, -1)
    own = np.minimum(a, len(low) - 1)
    crossing = (a <= b) & ~((a == b) & (low[own] <= first) & (end <= high[own]))
    for t in np.flatnonzero(a < b):                           # a token's few sections
        near = np.arange(a[t], b[t] + 1)
        shared = np.minimum(high[near], end[t]) - np.maximum(low[near], first[t])
        section[t] = near[int(np.argmax(shared))]
    return section, crossing


def counts(c: Codec, memo: Memo, texts: pa.Array, given: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (section, start, stop, tokens, crossing ones) of all texts, and the text of each row.
    All texts lie on one line, one after another, so that one search joins all spans."""
    first, end, tokens = token_spans(c, memo, texts)
    if given is None:
        spans, sections = line_sections(texts)
    else:
        each = [[(s["start"], s["stop"]) for s in x or ()] for x in given.to_pylist()]
        sections = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        spans = np.array(list(itertools.chain.from_iterable(each)), np.int64).reshape(-1, 2)
    n = len(texts)
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum(length + 1) - length - 1
    of_token, of_section = np.repeat(np.arange(n), np.diff(tokens)), np.repeat(np.arange(n), np.diff(sections))
    where, crossing = allot(first + base[of_token], end + base[of_token], spans + base[of_section][:, None])
    slot = np.where(where >= 0, n + where, of_token)          # a text's rest, then all sections
    total = np.bincount(slot, minlength=n + len(spans))
    crossed = np.bincount(slot[crossing], minlength=n + len(spans))
    owner = np.concatenate([np.arange(n), of_section])
    number = np.concatenate([np.full(n, -1), np.arange(len(spans)) - sections[of_section]])
    place = np.concatenate([np.full((n, 2), -1), spans])
    keep = np.r_[total[:n] > 0, np.ones(len(spans), bool)]
    order = np.flatnonzero(keep)[np.lexsort((number[keep], owner[keep]))]
    return np.column_stack([number, place, total, crossed])[order], owner[order]


def attribute(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", *, id_col: str = "doc_id",
              text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """``doc_id, section, start, stop, n_tokens, n_crossing`` per section of every document.

    ``sections_col`` names a column of array<struct<start, stop>> (code points, sorted, disjoint);
    without it a document's lines are its sections. Section -1 has what lies outside them, if any.
    """
    source = docs.select(id_col, text_col, *([sections_col] if sections_col else []))

    def kernel(batches):
        c = codec(vocabulary_path(vocabulary))
        memo = span_memo(c)
        for rb in text_slices(batches, text_col, SLICE_BYTES):
            rows, owner = counts(c, memo, rb.column(text_col), rb.column(sections_col) if sections_col else None)
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col).take(pa.array(owner)), *(pa.array(rows[:, k]) for k in range(5))],
                ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    kind = source.schema[id_col].dataType.simpleString()
    return in_arrow(source, kernel, f"doc_id {kind}, section long, start long, stop long, n_tokens long, n_crossing long")
