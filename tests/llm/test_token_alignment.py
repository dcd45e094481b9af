"""Token alignment against whole texts encoded by the two libraries; the hash; trees of several levels."""
import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuefind.llm import token_alignment as ta
from cuefind.llm.bpe import byte_chars

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_model(texts):
    """Per text its groups as pairs of id lists (none: no tokens), by the definition."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    chars = byte_chars()
    token_bytes = {i: bytes(map(chars.get, t)) for t, i in json.load(open(A_PATH, encoding="utf-8"))["model"]["vocab"].items() if set(t) <= set(chars)}
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            xs = [(i, token_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
            ys = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                  for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in xs) == b"".join(y for _, y in ys) == whole:
                x_end, y_end, x, y = 0, 0, [], []
                xs, ys = iter(xs), iter(ys)
                while max(x_end, y_end) < len(whole) or x_end != y_end:
                    if x_end <= y_end:
                        i, data = next(xs)
                        x.append(i)
                        x_end += len(data)
                    else:
                        i, data = next(ys)
                        y.append(i)
                        y_end += len(data)
                    if x_end == y_end:
                        groups.append((x, y))
                        x, y = [], []
        yield groups


def model(pairs):
    aligned = list(plain_model([t for _, t in pairs]))
    links = []
    for g in aligned:
        links.append(Counter())
        for x, y in g:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[-1][i, j] += n * m
    count = Counter(p for link in links for p in link)
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for (doc, _), g, link in zip(pairs, aligned, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(link.values()),
               sum(n for p, n in link.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in link.items()), hashlib.sha256(text.encode()).hexdigest() if text else "")


ODD = ["  two  blanks   three ", " lead", "trail ", "trail  ", "line\nbreak\n\n and  \n more\n", "tab\there \t x", "\n", " ", "  ", "\t \n ",
       "<s>it's</s> <|endoftext|> <0x41> <unk>", "▁literal mark", "a▁ b", "nul\x00byte", "漢字かな交じり文 と 空白", "nbsp here 　 wide",
       "emoji 👍🏽 family 👨‍👩‍👧", "é combining", "\x1c \x85x   y", "don't we'll I'M", "12345 67 8", ");\r\n }\r\n", "x" * 3000, "é" * 500 + " " + "ß",
       "wörter über Straße", "﻿bom", "a\r b \r", "​ zero width ‍"]


def check(docs, pairs):
    got = Counter(tuple(r) for r in ta.rows(docs).collect())
    assert got == Counter(model(pairs))


def test_against_whole_texts(make_docs, awkward):
    pairs = awkward + [(100 + i, t) for i, t in enumerate(ODD)] + [(300 + i, "the same words again and again") for i in range(40)]
    check(make_docs(pairs).repartition(5), pairs)


def test_random_strings(make_docs):
    rng = np.random.default_rng(1)
    letters = list("abcdeXYZ019 .,;'\"-_/  \n\t") + ["é", "ß", "漢", "😀", "▁", " ", "́", "\r", " the", " and"]
    pairs = [(i, "".join(rng.choice(letters, rng.integers(0, 60)))) for i in range(400)]
    check(make_docs(pairs), pairs)


def test_real_texts(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rows)


def test_several_levels_of_nodes(make_docs, monkeypatch):
    monkeypatch.setattr(ta, "FAN", 3)
    monkeypatch.setattr(ta, "SLICE_TEXT", 400)
    pairs = [(i % 7, f"document {i} speaks of words {i % 5} and Wörter {i * i}") for i in range(150)] + [(None, None)] * 30
    check(make_docs(pairs), pairs)


def test_counts_of_pairs(make_docs):
    pairs = [(1, "hello world"), (2, "hello there"), (3, None), (2, "hello there")]
    links = [{(i, j) for x, y in g for i in x for j in y} for g in plain_model([t for _, t in pairs])]
    want = Counter(p for link in links for p in link)
    got = ta.pair_counts(make_docs(pairs)).collect()
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in got} == dict(want) and len(got) == len(want)


def test_empty_table(make_docs):
    assert ta.rows(make_docs([])).collect() == []
    assert [tuple(r) for r in ta.rows(make_docs([(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_the_groups_themselves(make_docs):
    rows = {r["doc_id"]: r["groups"] for r in ta.rows(make_docs([(1, "hello world"), (2, "")]), with_groups=True).collect()}
    (groups,) = plain_model(["hello world"])
    assert rows == {1: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), 2: ""}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2 ** 32, n, dtype=np.uint64)).astype(np.uint32)
    found = ta.PairHash.unpack(ta.PairHash.build(keys).pack())
    assert sorted(found(keys).tolist()) == list(range(len(keys))) and found.size == len(keys)
    if n >= 1000:
        assert 8 * len(ta.PairHash.build(keys).pack()) < 4.5 * len(keys) + 2000
