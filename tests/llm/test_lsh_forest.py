"""The forest join against all pairs."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from cuefind.llm import lsh_forest as lf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def model(pairs):
    sets = [grams(t) if i is not None else set() for i, t in pairs]
    links = [[j for j in range(len(pairs)) if j != i and sets[i] and sets[j]
              and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(pairs))]
    label = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            low = min([label[i], *(label[j] for j in own)])
            changed, label[i] = changed or low != label[i], low
    members = {}
    for i, x in enumerate(label):
        members.setdefault(x, []).append(pairs[i][0])
    for i, (doc, _) in enumerate(pairs):
        yield doc, doc if not links[i] else min(members[label[i]]), len(links[i])


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(5000))
    out, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 45) + 1)):
                w[rng.randrange(len(w))] = word()
            out.append((n * 7 % 1009, " ".join(w)))
            n += 1
    return out


def same(docs, pairs, **options):
    assert Counter(map(tuple, lf.join(docs, **options).collect())) == Counter(model(pairs))


def test_against_all_pairs(make_docs, awkward):
    same(make_docs(awkward), awkward)
    pairs = near_copies(1)
    same(make_docs(pairs), pairs)
    assert any(n for _, _, n in model(pairs))


def test_tiles_of_one_node(make_docs):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(150)]
    pairs = []
    for i in range(120):                                   # one large group of near copies
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
        pairs.append((i, " ".join(w)))
    pairs += [(1000 + i, "an exact copy of some words in a row") for i in range(300)]
    same(make_docs(pairs), pairs, tile=16)


def test_texts_end_at_different_prefix_lengths(make_docs, spark):
    """A crowd of near copies keeps longer prefixes than texts that stand alone; whoever shares a text's
    prefix is in its leaf."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(200)]
    pairs = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        pairs.append((i, " ".join(w)))
    pairs += [(1000 + i, " ".join(f"alone{i}x{k}" for k in range(100))) for i in range(20)]
    depth = lf.prefix_depth()
    every = lf._text_rows(make_docs(pairs), "doc_id", "text", lf.TREES * depth)
    texts = every.selectExpr("tid", "doc_id", "1L as copies", "grams", "data")
    deep = {r["tid"]: [tuple(x) for x in r["deep"]] for r in lf._crowds(texts, lf.TREES, depth, 32).collect()}
    ids = {r["tid"]: r["doc_id"] for r in texts.collect()}
    lengths = {ids[t]: lf.prefix_lengths([deep.get(t, [])], lf.TREES, depth) for t in ids}
    assert all((lengths[1000 + i] == depth - lf.SHORTER).all() for i in range(20))
    assert {int(x) for i in range(90) for x in lengths[i].ravel()} == {depth - lf.SHORTER, depth - lf.SHORTER + 1, depth} or lengths[0].max() == depth
    paths = {r["doc_id"]: lf._paths([r["data"]], lf.TREES, depth)[0] for r in texts.collect()}
    for i in paths:
        for j in paths:
            for tree in range(lf.TREES):
                n = lengths[i][0, tree]
                if (paths[i][tree, n - 1] == paths[j][tree, n - 1]).all():
                    assert lengths[j][0, tree] == n
    same(make_docs(pairs), pairs)


@pytest.mark.parametrize("crowd", [1, 10 ** 9])
def test_links_do_not_depend_on_the_crowd(make_docs, crowd):
    pairs = near_copies(11)
    same(make_docs(pairs), pairs, crowd=crowd)


def test_first_of_class_takes_any_other_columns(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g", 5, "t", "x", 0, 1) for i in (3, 1, 2)],
                                 "doc_id long, text string, _row int, _doc string, tid string, label int, `a.b` int")
    out = lf.first_of_class(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f g", 5, "t", "x", 0, 1)]


def test_full_prefix_meets_the_recall():
    assert lf.prefix_depth(0.8, 0.5, 20, 8) == 8 > lf.prefix_depth(0.8, 0.999, 20, 8) >= 1
    d = lf.prefix_depth(0.8, 0.999, 20, 8)
    assert 1 - (1 - 0.8 ** d) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2 ** 63, 1000, dtype=np.uint64), rng.integers(0, 2 ** 63, 250, dtype=np.uint64)
    sets = [a, np.concatenate([a[:750], b])]               # 750 of 1250
    sig = lf.signatures(np.concatenate(sets), np.array([0, 1000, 2000]), 600)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.6, abs=0.08)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in lf.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_first_of_class_keeps_columns(make_docs):
    docs = make_docs([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words"), (None, "a b c d e f g"), (4, None)])
    out = lf.first_of_class(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 4, None]
    assert lf.join(make_docs([])).count() == 0


def test_first_of_class_by_row(make_docs):
    """Repeated rows leave one; of an id with two texts, the one that is no near copy stays."""
    same, other = "a b c d e f g", "quite another text with other words"
    docs = make_docs([(1, same), (1, same), (2, same), (2, other), (4, None), (4, None)])
    out = Counter((r["doc_id"], r["text"]) for r in lf.first_of_class(docs).collect())
    assert out == {(1, same): 1, (2, other): 1, (4, None): 2}
