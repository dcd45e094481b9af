"""Embedding job, streaming ingest replay, table store."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuefind.operators import embed as EM
from cuefind.session import scratch_path
from cuefind.sources import store as ST


def test_call_with_retry_orders_and_retries():
    calls, waits = [], []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise IOError("temporary")
        return [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]

    out = EM.call_with_retry(flaky, ["a", "bbb"], sleep=waits.append)
    assert out == [[1.0], [3.0]] and waits == [1.0, 2.0] and len(calls) == 3
    with pytest.raises(IOError):
        EM.call_with_retry(lambda t: (_ for _ in ()).throw(IOError("down")), ["x"], sleep=lambda s: None)


def test_embed_batches_of_ten(spark):
    def provider(texts):                                    # tells each text its place and its batch's size
        return [{"index": i, "embedding": [float(i), float(len(texts))]} for i in range(len(texts))]

    df = spark.createDataFrame([(f"c{i:02d}", f"t{i}") for i in range(25)], "chunk_id string, text string")
    rows = sorted(EM.embed_texts(df.coalesce(1), provider, pause_s=0.0).collect(), key=lambda r: r.chunk_id)
    assert [r.embedding for r in rows] == [[float(i % 10), 10.0 if i < 20 else 5.0] for i in range(25)]


def test_gap_between_calls(spark):
    def provider(texts):                                    # every text gets the time of its call
        now = time.time() % 1000
        return [{"index": i, "embedding": [now]} for i in range(len(texts))]

    df = spark.createDataFrame([(f"c{i:02d}", f"t{i}") for i in range(31)], "chunk_id string, text string").coalesce(1)
    at = sorted({r.embedding[0] for r in EM.embed_texts(df, provider).collect()})
    assert EM.PAUSE_S == 0.1 and len(at) == 4
    assert all(b - a >= 0.09 for a, b in zip(at, at[1:])) or at[-1] - at[0] > 900     # (or the clock turned)


def test_hashed_provider_unit_norm():
    v = EM.hashed_trigram_provider(16)(["hello world", ""])
    by_index = {d["index"]: np.array(d["embedding"]) for d in v}
    assert abs(np.linalg.norm(by_index[0]) - 1) < 1e-12 and not by_index[1].any()


def test_embed_pending_resumes(spark):
    chunks = spark.createDataFrame([("a", "x y", None), ("b", "z", [1.0]), ("c", "w", None)],
                                   "chunk_id string, text string, embedding array<float>")
    done = spark.createDataFrame([("a",)], "chunk_id string")
    got = [r.chunk_id for r in EM.embed_pending(chunks, EM.hashed_trigram_provider(4), done).collect()]
    assert got == ["c"]
    vec = EM.embed_pending(chunks, EM.hashed_trigram_provider(4))
    merged = {r.chunk_id: r.embedding for r in EM.apply_embeddings(chunks, vec).collect()}
    assert merged["b"] == [1.0] and all(merged[k] is not None for k in merged)


def test_store_create_if_absent(spark):
    root = scratch_path(spark, "store-test")
    df = ST.read_table(spark, root, "query_cache")
    assert df.count() == 0 and df.schema == ST.QUERY_CACHE


def test_segments_json_codec(spark):
    df = spark.createDataFrame([([("a", 0, 1500), ("b", 90061001, 90061002)],)],
                               "s array<struct<text:string,start_ms:bigint,end_ms:bigint>>")
    js = df.select(ST.segments_to_json(F.col("s")).alias("j")).first().j
    assert '"Start":"00:00:00"' in js and '"End":"00:00:01.5000000"' in js and '"Start":"1.01:01:01.0010000"' in js
    back = df.select(ST.segments_from_json(ST.segments_to_json(F.col("s"))).alias("b")).first().b
    assert [tuple(x) for x in back] == [("a", 0, 1500), ("b", 90061001, 90061002)]


def test_stream_ingest_replay_is_harmless(spark):
    from cuefind.operators import ingest as IN
    from cuefind.streaming.ingest_stream import run_ingest_stream
    listing = scratch_path(spark, "listing")
    spark.createDataFrame([("v1\tOne",), ("v2\tTwo",), ("",)], "value string").coalesce(1).write.text(listing)
    stt = spark.createDataFrame([("v1", 0, "hello", 0, 1), ("v1", 1, "world", 1, 2), ("v2", 0, "x", 0, 1)],
                                "video_id string, pos long, text string, start_ms long, end_ms long")
    none_f = spark.createDataFrame([], "video_id string")
    none_s = spark.createDataFrame([], "video_id string, pos long, text string, start_ms long, end_ms long")
    scripts = lambda w: IN.choose_scripts(w, none_f, none_s, stt)
    tables = scratch_path(spark, "tables")
    run_ingest_stream(spark, listing, tables, scratch_path(spark, "ck1"), scripts)
    # a second run with a fresh checkpoint replays every file: nothing is written twice
    run_ingest_stream(spark, listing, tables, scratch_path(spark, "ck2"), scripts)
    videos = ST.read_table(spark, tables, "videos")
    chunks = ST.read_table(spark, tables, "chunks")
    assert sorted(r.video_id for r in videos.collect()) == ["v1", "v2"]
    assert chunks.groupBy("chunk_id").count().where("count > 1").count() == 0
    # v1: "hello world" (T=30, stops), then "world" (T=50 duplicate skips the stop); v2: "x"
    assert chunks.count() == 3


def test_fetch_job_stage_flags(spark):
    from cuefind.operators import ingest as IN
    from cuefind.plans import fetch_job as FJ
    listing = scratch_path(spark, "listing")
    spark.createDataFrame([("v1\tOne",), ("v2\tTwo",), ("v3\tThree",)], "value string").coalesce(1).write.text(listing)
    stt = spark.createDataFrame([("v1", 0, "hello", 0, 1), ("v1", 1, "world", 1, 2), ("v2", 0, "x", 0, 1)],
                                "video_id string, pos long, text string, start_ms long, end_ms long")
    none_f = spark.createDataFrame([], "video_id string")
    none_s = spark.createDataFrame([], "video_id string, pos long, text string, start_ms long, end_ms long")
    scripts = lambda w: IN.choose_scripts(w, none_f, none_s, stt)
    tables = scratch_path(spark, "tables")
    stats = FJ.run_fetch_job(spark, [listing], tables, scripts)   # defaults: extract only
    assert stats == {"listed": 3, "stored_before": 0, "to_process": 3, "processed": 2, "missing_after": 1}
    assert ST.read_table(spark, tables, "chunks").count() == 0
    FJ.run_fetch_job(spark, [listing], tables, scripts, extract=False, chunk=True, embed=True)
    FJ.run_fetch_job(spark, [listing], tables, scripts, chunk=True, embed=True)   # rerun: nothing new
    chunks = FJ.chunks_with_vectors(spark, tables)
    assert chunks.count() == 3 and chunks.where("embedding IS NULL").count() == 0
    assert ST.read_table(spark, tables, "videos").count() == 2
    # only-missing off: every listed video is re-extracted and upserted in place
    stats = FJ.run_fetch_job(spark, [listing], tables, scripts, only_missing=False)
    assert ST.read_table(spark, tables, "videos").count() == 2 and stats["missing_after"] == 1


def test_stream_replay_after_partial_write(spark):
    """A batch that failed after appending segments but before the video row: the replay
    appends the video and no second copy of its segments."""
    from cuefind.operators import ingest as IN
    from cuefind.streaming.ingest_stream import run_ingest_stream
    listing = scratch_path(spark, "listing")
    spark.createDataFrame([("v1\tOne",)], "value string").coalesce(1).write.text(listing)
    stt = spark.createDataFrame([("v1", 0, "hello", 0, 1), ("v1", 1, "world", 1, 2)],
                                "video_id string, pos long, text string, start_ms long, end_ms long")
    none_f = spark.createDataFrame([], "video_id string")
    none_s = spark.createDataFrame([], "video_id string, pos long, text string, start_ms long, end_ms long")
    scripts = lambda w: IN.choose_scripts(w, none_f, none_s, stt)
    tables = scratch_path(spark, "tables")
    ST.append_table(stt, tables, "segments")                                       # the partial write
    run_ingest_stream(spark, listing, tables, scratch_path(spark, "ck"), scripts)
    assert ST.read_table(spark, tables, "segments").count() == 2
    assert ST.read_table(spark, tables, "videos").count() == 1
    assert ST.read_table(spark, tables, "chunks").count() == 2


def test_a_write_that_stops_half_way_changes_nothing(spark, monkeypatch):
    root = scratch_path(spark, "store-crash")
    row = lambda n: spark.createDataFrame([(f"c{n}", [float(n)])], ST.CHUNK_VECTORS)
    ST.append_table(row(1), root, "chunk_vectors")
    before = ST.read_table(spark, root, "chunk_vectors")

    def stop(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ST, "_commit", stop)                      # data written, no manifest
        for write in (ST.append_table, ST.replace_table):
            with pytest.raises(KeyboardInterrupt):
                write(row(2), root, "chunk_vectors")
    assert [r.chunk_id for r in ST.read_table(spark, root, "chunk_vectors").collect()] == ["c1"]
    # a manifest cut off in the middle is not a version
    fs, path = ST._fs(spark, f"{root}/chunk_vectors/_manifest-{9:012d}")
    out = fs.create(path, False)
    out.write(bytearray(b"part-gone\n"))
    out.close()
    ST.replace_table(ST.read_table(spark, root, "chunk_vectors").unionByName(row(3)), root, "chunk_vectors")
    assert sorted(r.chunk_id for r in ST.read_table(spark, root, "chunk_vectors").collect()) == ["c1", "c3"]
    assert [r.chunk_id for r in before.collect()] == ["c1"]  # a reader keeps its version
    ST.drop_old_versions(spark, root, "chunk_vectors")
    assert sorted(r.chunk_id for r in ST.read_table(spark, root, "chunk_vectors").collect()) == ["c1", "c3"]


def test_a_missing_folder_is_an_error(spark):
    root = scratch_path(spark, "store-missing")
    ST.append_table(spark.createDataFrame([("c", [1.0])], ST.CHUNK_VECTORS), root, "chunk_vectors")
    _, (part,) = ST.table_version(spark, root, "chunk_vectors")
    fs, path = ST._fs(spark, f"{root}/chunk_vectors/{part}")
    fs.delete(path, True)
    with pytest.raises(Exception, match="(?i)path"):
        ST.read_table(spark, root, "chunk_vectors").count()


def test_embedding_resumes_after_a_failed_bucket(spark):
    from cuefind.plans import fetch_job as FJ
    root = scratch_path(spark, "embed-resume")
    chunks = spark.createDataFrame([(f"c{i:03d}", f"text {i}") for i in range(60)], "chunk_id string, text string")
    full = chunks.select("chunk_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in ST.CHUNKS.fields[1:4]), "text",
                         *(F.lit(None).cast(f.dataType).alias(f.name) for f in ST.CHUNKS.fields[5:]))
    ST.append_table(full, root, "chunks")
    good = EM.hashed_trigram_provider(4)
    bad_text = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 2).first().text

    def failing(texts):
        if bad_text in texts:
            raise IOError("down")
        return good(texts)

    import unittest.mock as mock
    with mock.patch.object(EM, "RETRY_WAIT_S", (0.0, 0.0)), pytest.raises(Exception):
        FJ.embed_stage(spark, root, failing, commit_rows=25, pause_s=0.0)       # 60 rows: three buckets
    kept = ST.read_table(spark, root, "chunk_vectors").count()
    assert 0 < kept < 60
    FJ.embed_stage(spark, root, good, commit_rows=25, pause_s=0.0)
    vectors = ST.read_table(spark, root, "chunk_vectors")
    assert vectors.count() == 60 and vectors.select("chunk_id").distinct().count() == 60
    assert FJ.chunks_with_vectors(spark, root).where("embedding is null").count() == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace
    from cuefind import session
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
