"""The classifier's gradients, held-out accuracy and awkward rows; the pipeline against its stages."""
import importlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cuefind.llm import mil_classifier as mil
from cuefind.llm import queries
from cuefind.llm.common import split_words

D = "/root/testdata/sf0.01"


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, start, y = rng.normal(size=(9, mil.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    shape = {"W": (mil.FEATURES, 16), "b": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "c": (16,), "d": (1,)}
    p = {k: rng.normal(size=s) * 0.3 for k, s in shape.items()}

    def loss(p):
        z = mil._forward(p, x, start)["z"]
        return (np.log1p(np.exp(z)) - y * z).mean()

    for k, g in mil._gradient(p, x, start, y).items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(5)]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_attention_finds_the_passage():
    """The label hangs on one passage among many: the model must find it."""
    rng = np.random.default_rng(1)

    def bags(n):
        sizes = rng.integers(1, 12, n)
        start = np.concatenate([[0], np.cumsum(sizes)])
        x = rng.normal(size=(start[-1], mil.FEATURES)) * 0.5
        y = (rng.random(n) < 0.5).astype(float)
        for i in np.flatnonzero(y == 0):
            x[rng.integers(start[i], start[i + 1]), 3] += 6
        return x, start, y

    model = mil.train(*bags(600))
    x, start, y = bags(400)
    assert ((model.scores(x, start) >= 0.5) == (y == 1)).mean() > 0.93


def test_every_passage_counts():
    text = " ".join(f"w{k}" for k in range(5 * mil.PASSAGE + 7))
    x, start = mil.passages(pa.array([text, None, "", "one"]))
    assert np.diff(start).tolist() == [6, 1, 1, 1] and x[start[1], -1] == x[start[2], -1] == 1 and x[start[3], -1] == 0
    assert split_words(pa.array([text])).counts.tolist() == [5 * mil.PASSAGE + 7]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = queries.QUERIES["op4_attention_mil"](spark, D)
    assert rows.count() == docs.count()
    both = rows.join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").collect()
    for r in both:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in both if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)


def test_labels_of_the_held_out_fold_are_not_read(spark, make_docs):
    import pyspark.sql.functions as F
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(mil.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = mil.fit(docs, labels), mil.fit(docs, turned)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_awkward_rows_and_labels(spark, make_docs, awkward):
    docs = make_docs(awkward)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0), (7, 1), (12, 0), (99, 0)], "doc_id long, quality int")
    model = mil.fit(docs, labels)
    rows = mil.rows(docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in awkward)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert mil.accept(docs, model).columns == docs.columns
    assert mil.rows(make_docs([]), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in mil.rows(docs, mil.fit(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in mil.rows(docs, mil.fit(docs, good)).collect())


# ---- pipeline -----------------------------------------------------------------------------------

def test_stages(spark, tmp_path):
    """Each stage's decisions take effect, all but the last keep the columns, and run() is their composition."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join",
                                                     "substring dedup", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    before = spark.read.parquet(str(tmp_path / "1"))
    near = queries.lsh_forest.join(before.select("doc_id", "text"))
    assert kept[2] == near.select("class_id").distinct().count() < kept[1] < 1000
    cleaned = spark.read.parquet(str(tmp_path / "3"))
    assert cleaned.where("n_chars <> length(text)").count() == 0
    again = queries.substring_dedup.rows(cleaned.select("doc_id", "text"))
    left, was = again.agg({"n_words": "sum"}).first()[0], spark.read.parquet(str(tmp_path / "2"))
    rows = queries.substring_dedup.rows(was.select("doc_id", "text"))
    assert left == rows.selectExpr("sum(n_words - n_removed)").first()[0]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    first = spark.read.parquet(str(tmp_path / "0"))
    base = queries.quality_rules.rows(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text"))
    clean = base.where("not base_failed").join(labels.where("quality = 1"), "doc_id").select("doc_id")
    assert clean.join(first, "doc_id").count() >= 0.98 * clean.count()
    assert before.join(clean, "doc_id").count() >= 0.97 * clean.count()
    whole = corpus_pipeline.run(spark, D)
    assert whole.columns == docs.columns and whole.count() == pytest.approx(kept[-1], rel=0.02)
    assert whole.selectExpr("sum(length)").first()[0] == docs.selectExpr("sum(length)").first()[0]


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert sum(n.startswith("op") and n[2:].split("_")[0].isdigit() for n in names) == 13 and "pipeline" in names
    assert set(queries.ORACLE) <= set(names)


def test_stages_on_awkward_and_empty_documents(spark, make_docs, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra columns; and no documents at all."""
    for n, pairs in enumerate((awkward, [])):
        docs = make_docs(pairs)
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, make_docs(pairs), D)           # each stage on the raw rows too
            assert alone.count() >= 0
            if name in ("substring dedup", "n-gram Jaccard join") and pairs:
                assert None in {r["doc_id"] for r in alone.collect()}
            stage(spark, docs, D).write.parquet(str(tmp_path / f"{n}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{i}"))
            assert name == "packing" or docs.columns == columns
        assert pairs or docs.count() == 0


def test_training_sees_every_passage(spark, monkeypatch):
    """A text of 70 passages is trained on whole, and an id with several texts has a fixed one."""
    long = " ".join(f"w{k}" for k in range(70 * mil.PASSAGE))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs = spark.createDataFrame([(ids[0], long), (ids[1], "b b"), (ids[1], "a a a"), (ids[2], "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "train", lambda x, start, y: seen.append((np.diff(start).tolist(), x)))
    mil.fit(docs, labels)
    assert seen[0][0] == [70, 1, 1]
    assert np.allclose(seen[0][1][70], mil.passages(pa.array(["a a a"]))[0][0])


def test_pipeline_keeps_the_token_ids(spark, make_docs):
    from cuefind.llm import packing
    pieces = corpus_pipeline.packing_stage(spark, make_docs([(1, "some words"), (2, "more words here")]), D)
    for r in pieces.collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert sum(len(r["ids"]) // 4 for r in packing.sequences(pieces).collect()) == pieces.agg({"length": "sum"}).first()[0]
