"""Quality rules and sharding against plain Python."""
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cuefind.llm import quality_rules, splitters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_counts(spark, make_docs, awkward):
    for pairs in (awkward, [(i, r["text"]) for i, r in enumerate(
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]):
        got = quality_rules.rows(make_docs(pairs)).collect()
        assert len(got) == len(pairs)
        want = Counter((i, *model(t)) for i, t in pairs)
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_rules_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_rules.rows(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    both = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    assert both.where("quality = 1 and not kept").count() <= 0.02 * both.where("quality = 1").count()
    assert both.where("quality = 0 and kept").count() <= 0.1 * both.where("quality = 0").count()


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.full((len(good), quality_rules.RULES), quality_rules.ABSTAIN)
    for r, accuracy in enumerate([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6]):
        speaks, right = rng.random(len(good)) < 0.7, rng.random(len(good)) < accuracy
        vote = np.where(good == right, quality_rules.GOOD, quality_rules.BAD)
        votes[speaks, r] = vote[speaks]
    pattern, n = np.unique(quality_rules._pattern(votes), return_counts=True)
    p = quality_rules.fit(dict(zip(pattern.tolist(), n.tolist())))[quality_rules._pattern(votes)]
    majority = (votes == quality_rules.GOOD).sum(1) >= (votes == quality_rules.BAD).sum(1)
    assert ((p >= 0.5) == good).mean() > (majority == good).mean()
    assert ((p >= 0.5) == good).mean() > 0.93


def test_judge_keeps_columns_and_empty_table(make_docs, awkward):
    docs = make_docs(awkward)
    kept = quality_rules.judge(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert quality_rules.rows(make_docs([])).count() == 0 and quality_rules.judge(make_docs([])).count() == 0


def check_shards(rows, pairs, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == \
        Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in pairs)
    total, most = sum(size(t) for _, t in pairs), max(size(t) for _, t in pairs)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= most
    assert {r["law"] for r in rows} == {"bytes"}


def test_shards(spark, make_docs, awkward):
    check_shards(splitters.shard_table(make_docs(awkward)).collect(), awkward, 8)
    pairs = [(i, r["text"]) for i, r in enumerate(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect())]
    pairs += [(i, "the same text " * 20) for i in range(10_000, 10_600)]         # a large group
    check_shards(splitters.shard_table(make_docs(pairs)).collect(), pairs, 8)
    small = splitters.assign(make_docs(pairs), 8, ranges=4, samples=40, piece_rows=50)   # every range is subdivided
    check_shards(small.withColumn("law", F.lit("bytes")).collect(), pairs, 8)
    assert splitters.shard_table(make_docs([])).count() == 0


def test_rows_equal_in_id_and_text_are_many_lanes(make_docs):
    pairs = [(None, None)] * 3000 + [(i, f"text {i}") for i in range(500)]
    placed = splitters.assign(make_docs(pairs), 8, piece_rows=100).withColumn("law", F.lit("bytes")).collect()
    check_shards(placed, pairs, 8)
    lanes = Counter((r["_range"], r["_lane"]) for r in placed if r["doc_id"] is None)
    assert len(lanes) >= 25 and max(lanes.values()) < 250


def test_equal_texts_are_neighbours(make_docs):
    pairs = [(i, f"text {i // 5}") for i in range(500)]
    rows = splitters.shard_table(make_docs(pairs)).collect()
    split = sum(len({r["shard"] for r in rows if r["doc_id"] // 5 == g}) > 1 for g in range(100))
    assert split <= 7                                                            # only at shard borders


def test_written_shards(spark, make_docs, awkward, tmp_path):
    docs = make_docs(awkward)
    splitters.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).select("record.*")
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.collect()))


def test_poor_vocabulary_of_long_texts_is_bad():
    """A text shuffled from a hundred words is voted bad at any length; a rich long one is not."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    poor = [" ".join(f"w{k}" for k in rng.integers(0, 100, n)) for n in (1999, 2000, 2001, 20_000)]
    rich = " ".join(f"w{k}" for k in rng.integers(0, 2000, 20_000))
    got = quality_rules.votes(quality_rules.measure(pa.array([*poor, rich])))[:, 5]
    assert got.tolist() == [quality_rules.BAD] * 4 + [quality_rules.ABSTAIN]
