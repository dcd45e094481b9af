"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a word there is one last token that the exact encoding of that prefix ends
in. The automaton of the vocabulary (its suffix links list all tokens that end at a place) offers
the candidates; a candidate stands if it is compatible with the last token of the prefix before
it, that is, if the merges of the two tokens' bytes alone lead to just these two tokens. The
table of last tokens is filled left to right, and back-pointers give the ids. The work is linear
in the word's length, however long a run without breaks is; the merge list is never replayed over
a text. Frequent words are remembered per worker (a bounded table), so a text costs one split
and a look-up per word.

The vocabulary file is a parameter; special tokens written in a text become their ids, as the
tokenizers library has it by default. Decoding joins the tokens' bytes and replaces what is not
UTF-8.

Cases: null and empty texts have no tokens and decode to an empty text; ids may be null or
repeat; texts of any length are encoded whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuefind.llm.common import in_arrow, segment_sum, text_slices

#: Fixed value: how byte-level BPE splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode white space without the blank.
_WHITE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space other than one blank between two words.
GAP = re.compile(f"( ?[{_WHITE}][ {_WHITE}]*| {{2,}}[{_WHITE}]?[ {_WHITE}]*)")
#: One mark after a word, and a word of Latin letters with at most one such mark.
_MARKS = ".,;:!?"
_PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"
#: Words that a worker remembers, and the longest word worth remembering.
CACHE_WORDS = 1 << 19
CACHE_CHARS = 64
#: Text bytes that are cut into words at a time: a word that repeats in them is looked up once.
SLICE_BYTES = 8 << 20


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: the byte's own
    character where Latin-1 prints it, else the next free one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo:
    """What a worker remembers per word, with the blank before it if there is one (bounded)."""

    def __init__(self, codec: Codec, make):
        self.codec, self.make = codec, make         # make: from a run of the pattern's words
        self.known: dict[str, object] = {}

    def __call__(self, chunk: str):
        value = self.known.get(chunk)
        if value is None:
            value = self.make(self.codec.find(chunk))
            if len(chunk) <= CACHE_CHARS:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[chunk] = value
        return value


@dataclass
class Chunks:
    """Texts cut before each blank, and before a mark after Latin letters. Where a single blank parts
    two words it always starts the next word of the pattern, so a text's tokens are those of its chunks: ``chunk[codes]``, text i at
    ``start[i]:start[i+1]``. Texts with other blanks are ``odd``: they have no codes here."""

    codes: np.ndarray
    start: np.ndarray
    chunk: list[str]
    odd: np.ndarray


def split_chunks(texts: pa.Array) -> Chunks:
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocab = coded.dictionary
    bad = pc.match_substring_regex(vocab, f"^$|^[{_WHITE}]|[{_WHITE}]$").to_numpy(zero_copy_only=False)[codes]
    odd = segment_sum(bad.astype(np.int64), offsets) > 0
    size = np.diff(offsets)
    first = np.zeros(len(codes), np.int64)
    first[offsets[:-1]] = 1
    key, codes = np.unique((codes * 2 + first)[np.repeat(~odd, size)], return_inverse=True)
    blank = pa.array([" ", ""]).take(pa.array(key % 2))
    chunk = pc.binary_join_element_wise(blank, vocab.take(pa.array(key // 2)), "")
    # letters and a mark after them are two words of the pattern
    plain = pc.match_substring_regex(chunk, _PLAIN)
    stem = pc.if_else(plain, pc.utf8_rtrim(chunk, characters=_MARKS), chunk)
    mark = pc.if_else(plain, pc.index_in(pc.utf8_slice_codeunits(chunk, start=-1), value_set=pa.array(list(_MARKS))), -1)
    mark = pc.fill_null(mark, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = stem.dictionary_encode()
    stem = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = coded.dictionary.to_pylist()
    two = (mark >= 0)[codes]
    at = np.cumsum(1 + two) - 1 - two
    out = np.empty(len(codes) + int(two.sum()), np.int64)
    out[at] = stem[codes]
    out[at[two] + 1] = len(pieces) + mark[codes[two]]
    start = np.concatenate([[0], np.cumsum(1 + two)])[np.concatenate([[0], np.cumsum(np.where(odd, 0, size))])]
    return Chunks(out, start, pieces + list(_MARKS), odd)


class Codec:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE" \
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        chars = byte_chars()
        self.bytes_of = {i: bytes(chars[c] for c in t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            left, right = model["vocab"][a], model["vocab"][b]
            self.rank[left, right] = (r, ids[self.bytes_of[left] + self.bytes_of[right]])
        self.split: dict[int, tuple[int, int, int]] = {}      # token -> rank and halves of its merge
        for (left, right), (r, whole) in self.rank.items():
            if max(self.split.get(left, (-1,))[0], self.split.get(right, (-1,))[0]) >= r:
                raise ValueError("a merge needs a token that a later merge makes")
            self.split.setdefault(whole, (r, left, right))
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self._compatible: dict[int, bool] = {}
        self.memo = Memo(self, self.ids_of)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ids.items():
            if self._merged(b) == [i]:      # else no text ever encodes to it
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _merged(self, data: bytes) -> list[int]:
        """The merges applied to the bytes of one or two tokens."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in self.rank), default=None)
            if best is None:
                break
            (_, joined), k = best
            out[k:k + 2] = [joined]
        return out

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand in turn at an end of ``token`` while its bytes merge (side 0: at
        its left end, 1: at its right end), each with the rank of the merge that takes it away."""
        out, until = [(token, float("inf"))], token
        while until in self.split:
            rank, *halves = self.split[until]
            until = halves[side]
            out.append((until, rank))
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges of the two tokens' bytes lead to just these two tokens? They do unless
        a merge across the seam comes up before both of its sides have merged inwards."""
        if len(self._compatible) > 2 * CACHE_WORDS:
            self._compatible.clear()
        right, left, i, j, found = self._edge(a, 1), self._edge(b, 0), 0, 0, True
        while True:
            (x, x_gone), (y, y_gone) = right[i], left[j]
            across = self.rank.get((x, y))
            if across is not None and across[0] < x_gone and across[0] <= y_gone:
                found = False       # of equal ranks the leftmost pair merges first
                break
            if x_gone == y_gone == float("inf"):
                break
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1
        self._compatible[a << 32 | b] = found
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Fill the table of last tokens prefix by prefix, then follow the back-pointers."""
        data = word.encode("utf-8").decode("latin-1")
        last, size, known = [-1] * (len(data) + 1), self.size, self._compatible.get
        for end, token in self.automaton.iter(data):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size[token]
            if not before:
                last[end] = token
            elif (left := last[before]) >= 0:
                fits = known(left << 32 | token)
                if fits if fits is not None else self.compatible(left, token):
                    last[end] = token
        out, at = [], len(data)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return tuple(out)

    def ids_of(self, words: list[str]) -> tuple[int, ...]:
        """Ids of a run of the pattern's words."""
        if len(words) == 1:
            return self.encode_word(words[0])
        return tuple(itertools.chain.from_iterable(map(self.encode_word, words)))

    def pieces(self, text: str):
        """The text cut at special tokens: (part, its id or None)."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part:
                yield part, self.special.get(part)

    def value(self, chunk: str, memo: Memo, special) -> list:
        """What ``memo`` has for one chunk (more than one value only where special tokens are in it)."""
        if self.cut is None or not any(s in chunk for s in self.special):
            return [memo(chunk)]
        return [special(part, token) if token is not None else memo(part) for part, token in self.pieces(chunk)]

    def walk(self, text: str, memo: Memo, special) -> list:
        """What ``memo`` has for the words of any text, in order: gaps other than one blank between two
        words take the pattern's look-ahead."""
        values: list = []
        for part, token in self.pieces(text):
            if token is not None:
                values.append(special(part, token))
                continue
            bits, blank = GAP.split(part), ""
            for k in range(0, len(bits), 2):
                if bits[k]:
                    head, *words = bits[k].split(" ")
                    values += [memo(blank + head)] if blank + head else []
                    values += [memo(" " + w) for w in words]
                if k + 1 < len(bits):
                    ending = k + 3 == len(bits) and not bits[k + 2]
                    found = self.find(bits[k + 1] + ("" if ending else "x"))
                    blank = "" if ending or found[-1] == "x" else " "
                    values.append(memo.make(found if ending else found[:-1]))
        return values

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.walk(text, self.memo, lambda _, token: (token,))))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    return Codec(path)


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>) per document."""
    source = docs.select(id_col, text_col)

    def kernel(batches):
        c = codec(vocabulary_path(vocabulary))
        for rb in text_slices(batches, text_col):
            ids = [c.encode(t or "") for t in rb.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return in_arrow(source, kernel, f"doc_id {source.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", *, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` per row of token ids (null ids: an empty text)."""
    source = encoded.select(id_col, ids_col)

    def kernel(batches):
        c = codec(vocabulary_path(vocabulary))
        for rb in batches:
            texts = [c.decode(ids or ()) for ids in rb.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(source, kernel, f"doc_id {source.schema[id_col].dataType.simpleString()}, text string")


def _digest_memo(c: Codec) -> Memo:
    """Per word: number of tokens, their ids in decimal, and the bytes that the ids decode to."""
    def make(words):
        ids = c.ids_of(words)
        return len(ids), ",".join([c.decimal[i] for i in ids]), b"".join([c.bytes_of[i] for i in ids])
    return Memo(c, make)


def _digests(c: Codec, memo: Memo, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    special = lambda _, i: (1, c.decimal[i], c.bytes_of[i])
    merged = lambda v: v[0] if len(v) == 1 else (sum(x[0] for x in v), ",".join(x[1] for x in v if x[0]), b"".join(x[2] for x in v))
    ch = split_chunks(texts)
    values = [merged(c.value(x, memo, special)) for x in ch.chunk] or [(0, "", b"")]
    count, decimal, data = zip(*values)
    n = segment_sum(np.array(count, np.int64)[ch.codes], ch.start)
    offsets, pick = pa.array(ch.start, pa.int32()), pa.array(ch.codes)
    ids = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(decimal).take(pick)), ",").to_pylist()
    back = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(data, pa.binary()).take(pick)), b"").to_pylist()
    for i in np.flatnonzero(ch.odd):
        n[i], ids[i], back[i] = merged(c.walk(texts[i].as_py() or "", memo, special) or [(0, "", b"")])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return n, [sha(x.encode()) for x in ids], [sha(x.decode("utf-8", errors="replace").encode()) for x in back]


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", *, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """The digest rows of ``op7``: both ways in one pass, so that no id list leaves the task."""
    source = docs.select(id_col, text_col)

    def kernel(batches):
        c = codec(vocabulary_path(vocabulary))
        memo = _digest_memo(c)
        for rb in text_slices(batches, text_col, SLICE_BYTES):
            n, ids, back = _digests(c, memo, rb.column(text_col))
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array(n), pa.array(ids), pa.array(back)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(source, kernel, f"doc_id {source.schema[id_col].dataType.simpleString()}, n_tokens long, "
                                    "ids_sha256 string, decoded_sha256 string")
