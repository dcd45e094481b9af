"""Hard negatives against brute force; the vertical scan's windows, ties, pruning and large numbers."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from cuefind.llm import bond_negatives as bn

SCHEMA = "vec_id long, label int, embedding array<float>, tag string, anchor int, home string"


def model(rows, every=50):
    use, seen = [], set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in seen:
            seen.add(row)
            use.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in use:
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, m) for j, m, w in use if j != i))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            for rank, (t, j, _) in enumerate(fits, 1):
                yield i, p, rank, j, -s, -t


def random_rows(seed, n, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (labels, dims))
    return [(i, int(i % labels), (centres[(i * 7) % labels] + rng.normal(0, 0.15, dims)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def make_vectors(spark):
    real = lambda v: v if v is None else [x if x is None else float(x) for x in v]
    return lambda rows: spark.createDataFrame([(i, label, real(v), "t", 1, "h") for i, label, v in rows], SCHEMA)


def check(make_vectors, rows):
    got = Counter(tuple(r) for r in bn.rows(make_vectors(rows)).collect())
    assert got == Counter(model(rows)) and got


def test_against_brute_force(make_vectors):
    check(make_vectors, random_rows(1, 400))


def test_many_blocks_groups_and_slices(make_vectors, monkeypatch):
    monkeypatch.setattr(bn, "BLOCK_CELLS", 600)
    monkeypatch.setattr(bn, "ANCHORS", 3)
    monkeypatch.setattr(bn, "SLICE_BLOCKS", 1)
    rows = random_rows(2, 900, labels=3)
    check(make_vectors, rows)
    check(make_vectors, [(i, 1 if i % 3 else label, v) for i, label, v in rows])     # one label with most rows


def test_awkward_rows(make_vectors):
    rng = random.Random(3)
    same = [0.5, 0.25, -0.125]
    rows = [(i, i % 2, same) for i in range(0, 120)]                                  # all scores tie
    rows += [(i, 0, same) for i in range(0, 120, 2)]                                  # repeated rows
    rows += [(50, 1, [0.3, 0.3, 0.3]), (100, 3, [1.0, 0.0, 0.0]), (201, 3, [0.7, 0.1, 0.0]), (202, 4, [0.6, 0.1, 0.0])]
    rows += [(None, 1, same), (203, None, same), (204, 1, None), (205, 1, [float("nan"), 0, 0]), (206, 2, [float("inf"), 0, 0]),
             (207, 2, [None, 1.0, 1.0]), (208, 2, []), (209, 2, [0.0, 0.0, 0.0]), (210, 2, [0.9]), (250, 5, [-0.5, -0.5, 0.1])]
    rows += [(300 + i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(100)]
    rng.shuffle(rows)
    check(make_vectors, rows)


def test_no_rows(make_vectors):
    assert bn.rows(make_vectors([])).collect() == []
    assert bn.rows(make_vectors([(50, 1, [1.0]), (51, 2, [1.0])])).collect() == []    # an anchor without positives
    assert bn.rows(make_vectors([(1, 1, [1.0]), (2, 1, [1.0])])).collect() == []      # no anchor


def test_numbers_beyond_doubles(make_vectors):
    big = float(2 ** 22)
    rows = [(50, 1, [big, big + 1.0, 1.0]), (51, 1, [big, big, 1.5]), (52, 1, [big, big, 1.25]), (53, 2, [big * 0.75, big * 0.75, 1.0]),
            (54, 2, [big * 0.75, big * 0.75, 1.00390625])] + [(60 + i, 2, [big * 0.6, big * 0.7, i / 256]) for i in range(20)]
    check(make_vectors, rows)


def _scan(block, anchor, k, low, high):
    count = [0]
    (rows, scores), = bn.vertical_scan(block, anchor, np.arange(len(block.ids)), k, np.array([low], object), np.array([high], object),
                                       np.array([low], object), count)
    return block.ids[rows].tolist(), scores.tolist(), count[0]


def test_the_scan_reads_less_than_all(make_vectors):
    rng = np.random.default_rng(4)
    n, dims = 4000, 64
    weight = 2.0 ** -np.arange(dims) ** 0.5                     # a few dimensions decide
    vectors = np.floor(256 * rng.normal(0, 1, (n, dims)) * weight).astype(np.int64)
    block = bn.Block(np.arange(n), np.zeros(n, np.int64), np.ascontiguousarray(vectors.T), 1 << 20)
    scores = vectors @ vectors[7]
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    for low, high in ((-2**60, 2**60), (scores[7] // 2, scores[7] * 95 // 100), (10**12, 2 * 10**12)):
        ids, got, read = _scan(block, vectors[7], 5, int(low), int(high))
        assert ids == [i for i in order if low <= scores[i] <= high][:5] and got == [scores[i] for i in ids]
        assert read < 0.6 * n * dims
