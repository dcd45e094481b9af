"""Block anchors against a brute-force window count."""
import hashlib
import random
import re
from collections import Counter

import numpy as np

from cuefind.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(pairs):
    key = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in pairs:
        w = WORD.findall(t or "")
        for p in range(len(w) - 19):
            k = (*key(i), p)
            first[tuple(w[p:p + 20])] = min(first.get(tuple(w[p:p + 20]), k), k)
    for i, t in pairs:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p:p + 20])] < (*key(i), p):
                gone |= set(range(p, p + 20))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def planted(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 29, 35, 60, 200)]
    out = []
    for i in range(docs):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for s in rng.sample(shared, rng.randrange(0, 4)):
            at, a = rng.randrange(len(w) + 1), rng.randrange(0, 5)
            w[at:at] = s[a:len(s) - rng.randrange(0, 5)]
        out.append((rng.randrange(docs * 3), rng.choice([" ", "\n", " \t "]).join(w)))
    return out


def same(docs, pairs):
    assert Counter(map(tuple, sd.rows(docs).collect())) == Counter(model(pairs))


def test_against_brute_force(make_docs, awkward):
    same(make_docs(awkward), awkward)
    pairs = planted(1) + planted(2)[:20] + [(1000 + i, "the very same passage " * 30 + f"own{i} " * 3) for i in range(40)]
    same(make_docs(pairs), pairs)


def test_many_tasks_and_flushes(make_docs, monkeypatch):
    pairs = planted(3, 150)
    same(make_docs(pairs).repartition(13), pairs)
    monkeypatch.setattr(sd, "FLUSH_WORDS", 50)
    same(make_docs(pairs).coalesce(1), pairs)


def test_repeats_inside_one_document(make_docs):
    pairs = [(1, " ".join(["a b c d e f g"] * 20)), (2, " ".join(["q"] * 70)), (3, " ".join(map(str, range(25))) + " x " + " ".join(map(str, range(25))))]
    same(make_docs(pairs), pairs)


def test_clean_keeps_columns_and_spacing(make_docs):
    words = " ".join(f"w{k}" for k in range(30))
    docs = make_docs([(1, words), (2, f"head\n here  \n{words}\ntail  end"), (3, None), (4, "  short\t text ")])
    out = sd.clean(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == words and got[3]["text"] is None and got[4]["text"] == "  short\t text "
    assert got[2]["text"] == "head\n here tail  end" and got[2]["n_chars"] == len(got[2]["text"]) and got[2]["extra"] == "x"
    assert sd.clean(make_docs([])).count() == 0 and sd.rows(make_docs([])).count() == 0


def test_clean_takes_any_other_columns(spark):
    words = " ".join(f"w{k}" for k in range(30))
    clash = "doc_id long, _row string, _doc string, _chunk int, _text string, _id long, text string, _part array<int>, `a.b` struct<`x y`: int>"
    docs = spark.createDataFrame([(i, f"row{i}", "d", i, "other text", 7, f"{words} own{i}", [i], (i,)) for i in (1, 2)], clash)
    out = sd.clean(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and got[1]["text"] == f"{words} own1" and got[2]["text"] == "own2"
    assert all(got[i][:6] == (i, f"row{i}", "d", i, "other text", 7) and got[i][7:] == ([i], (i,)) for i in (1, 2))


def test_documents_that_share_a_hash(make_docs, monkeypatch):
    """Every document gets one of five hashes: results stay those of the brute-force version."""
    pairs = planted(5, 80)
    real = sd.F.xxhash64
    monkeypatch.setattr(sd.F, "xxhash64", lambda *c: sd.F.pmod(real(*c), sd.F.lit(5)))
    same(make_docs(pairs + pairs[:9]), pairs + pairs[:9])


def test_rolling_hash_depends_on_order():
    h = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x123456789ABCDEF1)
    assert len(np.unique(sd._rolling(h, 20))) == 40 and sd._rolling(h[::-1].copy(), 20)[0] != sd._rolling(h, 20)[-1]
