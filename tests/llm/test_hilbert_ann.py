"""Hilbert keys, and the search against brute force."""
import itertools

import numpy as np
import pytest

from cuefind.llm import hilbert_ann as ha

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_key_is_a_curve(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = ha.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()        # neighbours on the curve touch


def brute(rows, k=20):
    """{query: [(vec_id, score)]} over rows with a usable vector; repeated rows count once."""
    usable = {(i, tuple(np.float32(v).astype(float))) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for i, v in usable:
        if i % 20 == 0:
            found = [(j, float(np.dot(v, w))) for j, w in usable if j != i and len(w) == len(v)]
            yield i, sorted(found, key=lambda p: (-p[1], p[0]))[:k]


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows],
                                 "vec_id long, embedding array<float>, rank int, score string")


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [NAN, 1.0, 0.0, 0.0]), (180, [INF, 0.0, 0.0, 1.0]),
             (None, [1.0, 0.0, 0.0, 0.0]), (200, []), (220, [1.0, 2.0]), (240, [2.0, 1.0]), (40, rows[40][1])]
    got = results(ha.search(frame(spark, rows), lambda i: i % 20 == 0))
    want = dict(brute(rows))
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], atol=1e-12)
    assert ha.search(frame(spark, []), lambda i: i % 20 == 0).count() == 0
    assert ha.search(frame(spark, [(1, [1.0])]), lambda i: i % 20 == 0).count() == 0


def test_many_equal_vectors(spark):
    """A vector that a third of the rows share: its copies are ranked by id, and nothing is lost."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    got = results(ha.search(frame(spark, rows), lambda i: i % 20 == 0, block_points=64))
    want = dict(brute(rows))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in found}) for q, found in want.items())
    assert hit >= 0.9 * sum(len(found) for found in want.values())
    assert all(len(got[q]) == 20 for q in want)
    copies = [i for i, _ in got[60]][:20]
    assert copies == [i for i in range(0, 64, 3) if i != 60][:20] or got[60][0][1] > 0.75


def test_recall_with_small_blocks(spark):
    """Many blocks, so that the windows really leave points out: recall on clustered and on random vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    for vectors in (rng.normal(size=(3000, 24)), centres[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 24)),
                    rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))):      # and of unequal length
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        got = results(ha.search(frame(spark, rows), lambda i: i % 20 == 0, block_points=32))
        want = dict(brute(rows))
        hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in found}) for q, found in want.items())
        assert hit >= 0.9 * sum(len(found) for found in want.values())


def test_each_pair_is_scored_once(spark):
    """Fewer pairs than an exact scan at the recall asked for, on vectors at random too, with many blocks."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(50, 32))
    shares = []
    for vectors in (rng.normal(size=(2000, 32)), centres[rng.integers(0, 50, 2000)] + 0.1 * rng.normal(size=(2000, 32))):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        assert ha.block_count(2000, ha.BLOCK_POINTS) >= 25
        got = results(ha.search(frame(spark, rows), lambda i: i % 20 == 0))
        want = dict(brute(rows))
        hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in found}) for q, found in want.items())
        assert hit >= 0.9 * sum(len(found) for found in want.values())
        shares.append(ha.scored_pairs(frame(spark, rows), lambda i: i % 20 == 0) / (len(want) * 2000))
    assert shares[0] < 1 and shares[1] < 0.6 * shares[0]


def test_cell_sizes_beyond_the_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    one = results(ha.search(frame(spark, rows), lambda i: i % 20 == 0))
    monkeypatch.setattr(ha, "CELL_BYTES", 0)
    assert results(ha.search(frame(spark, rows), lambda i: i % 20 == 0)) == one


def test_met_before_is_the_first_window_that_holds_a_pair():
    rng = np.random.default_rng(7)
    blocks, low = rng.integers(0, 10, (30, 4)), rng.integers(0, 8, (9, 4))
    high = low + rng.integers(0, 3, (9, 4))
    times = sum((~ha._met_before(o, blocks, low, high) & (blocks[:, o] >= low[:, o, None]) & (blocks[:, o] <= high[:, o, None])).astype(int)
                for o in range(4))
    held = ((blocks[None] >= low[:, None]) & (blocks[None] <= high[:, None])).any(axis=2)
    assert (times == held).all()


def test_double_precision_is_kept(spark):
    near = 1.0 + 2.0 ** -40
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [near, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ha.search(df, lambda i: i == 0).orderBy("rank").collect()] == [(2, near), (1, 1.0)]


def test_windows_follow_the_data():
    """Clustered vectors need narrower windows than random ones at the same recall."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    widths = []
    for x in (rng.normal(size=(4000, 32)), centres[rng.integers(0, 60, 4000)] + 0.05 * rng.normal(size=(4000, 32))):
        curves = ha.fit(x, float(np.linalg.norm(x, axis=1).max()), 12, 6)
        probe = x[:40]
        near = [x[np.argsort(-(x @ q))[:21]] for q in probe]
        widths.append(ha.window_width(curves, probe, near, 0.95))
    assert widths[1] < widths[0] / 2
