"""Bucketed tables: races between writers, untouched buckets, marks; cache streams, replays and restarts; backfill runs."""

import datetime as dt
import unittest.mock as mock

import pytest
from pyspark.sql import functions as F

from cuefind.operators import cache as CA
from cuefind.operators import embed as EM
from cuefind.plans import fetch_job as FJ
from cuefind.session import scratch_path
from cuefind.sources import store as ST
from cuefind.streaming import cache_stream as CS

T0 = dt.datetime(2024, 1, 1)


def _entries(spark, names, count=1, chunk="c1"):
    return spark.createDataFrame([(n, chunk, T0, T0, count) for n in names], ST.QUERY_CACHE)


def _counts(spark, root):
    return {r.normalized_query: r.access_count for r in ST.read_table(spark, root, "query_cache").collect()}


def _add(spark, root, rows, **kw):
    ST.upsert_table(spark, root, "query_cache", rows, lambda old: CA.cache_upsert(old, rows), **kw)


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark):
    root = scratch_path(spark, "buckets")
    ST.replace_table(_entries(spark, [f"q{i}" for i in range(200)]), root, "query_cache", buckets=16)
    before = ST.read_version(spark, root, "query_cache")
    assert len(before.folders) == 16 and before.buckets == 16
    _add(spark, root, _entries(spark, ["q7", "new one"], 5))
    after = ST.read_version(spark, root, "query_cache")
    touched = {f"bucket={r[0]}" for r in _entries(spark, ["q7", "new one"]).select(ST.bucket_of("query_cache", 16)).collect()}
    same = {f for f in before.folders if f.rpartition("/")[2] not in touched}
    assert 14 <= len(same) and same == set(before.folders) & set(after.folders) and len(after.folders) == 16
    got = _counts(spark, root)
    assert got["q7"] == 6 and got["new one"] == 5 and got["q8"] == 1 and len(got) == 201
    ST.drop_old_versions(spark, root, "query_cache")
    assert _counts(spark, root) == got


def test_untouched_buckets_are_not_read(spark):
    root = scratch_path(spark, "pruned")
    ST.replace_table(_entries(spark, [f"q{i}" for i in range(100)]), root, "query_cache", buckets=8)
    seen = []
    rows = _entries(spark, ["q3"])
    ST.upsert_table(spark, root, "query_cache", rows, lambda old: seen.extend(old.inputFiles()) or CA.cache_upsert(old, rows))
    assert len({f.rpartition("/")[0] for f in seen}) == 1


def test_two_writers_lose_nothing(spark):
    """A change computed from an older version is refused; the same change on the newest one is not."""
    root = scratch_path(spark, "race")
    ST.replace_table(_entries(spark, ["a"]), root, "query_cache")
    read = ST.read_version(spark, root, "query_cache")
    rows = ST.read_table(spark, root, "query_cache", read)
    ST.append_table(_entries(spark, ["b"]), root, "query_cache")                # the other writer
    with pytest.raises(ST.StaleTable):
        ST.replace_table(rows.unionByName(_entries(spark, ["c"])), root, "query_cache", version=read)
    with pytest.raises(ST.StaleTable):
        _add(spark, root, _entries(spark, ["a"]), version=read)
    assert _counts(spark, root) == {"a": 1, "b": 1}
    _add(spark, root, _entries(spark, ["a"]))
    assert _counts(spark, root) == {"a": 2, "b": 1}


def test_a_merge_that_lost_is_done_again_on_the_newest_version(spark):
    root = scratch_path(spark, "retry")
    ST.replace_table(_entries(spark, ["a"]), root, "query_cache")
    rows, calls = _entries(spark, ["a"], 10), []

    def merge(old):
        calls.append(1)
        if len(calls) == 1:
            _add(spark, root, _entries(spark, ["a"], 100))                      # another writer comes in between
        return CA.cache_upsert(old, rows)

    ST.upsert_table(spark, root, "query_cache", rows, merge)
    assert _counts(spark, root) == {"a": 111} and len(calls) == 2


def _search_case(spark):
    texts = [("c1", "captain rocket flies", [1.0, 0.0]), ("c2", "laser spear", [0.0, 1.0])]
    chunks = spark.createDataFrame([(c, "v", t, t, 0, v) for c, t, v in texts],
                                   "chunk_id string, video_id string, text string, normalized_text string, start_ms long, embedding array<float>")
    videos = spark.createDataFrame([("v", "Title", "https://www.youtube.com/watch?v=abcdefghijk")], "video_id string, title string, video_url string")
    ask = lambda rows: spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), q, [1.0, 0.0]) for i, q in rows],
                                             "event_id long, ts timestamp_ntz, query string, embedding array<float>")
    return chunks, videos, ask


def test_a_search_that_lost_the_race_is_answered_again(spark):
    chunks, videos, ask = _search_case(spark)
    root = scratch_path(spark, "search-race")
    ST.replace_table(_entries(spark, ["other"]), root, "query_cache")
    seen = []

    def interfere(shaped):
        seen.append(shaped)
        if len(seen) == 1:      # someone else answers the same query first, otherwise
            ST.append_table(_entries(spark, ["captain rocket"], 7, "c2"), root, "query_cache")

    out = CA.cached_search(spark, root, ask([(1, "Captain Rocket")]), chunks, videos, before_commit=interfere).first()
    assert out.source == "cache" and out.chunk_id == "c2" and len(seen) == 2
    assert _counts(spark, root) == {"other": 1, "captain rocket": 8}


def test_search_stream_counts_each_request_once(spark):
    chunks, videos, ask = _search_case(spark)
    root, folder, answers, ckpt = (scratch_path(spark, x) for x in ("stream-store", "stream-in", "stream-out", "stream-ckpt"))
    batches = [ask([(1, "captain rocket"), (2, "Captain, rocket"), (3, " ")]), ask([(4, "captain rocket"), (5, "laser"), (6, "x" * 65)])]
    for b in batches:
        b.write.mode("append").parquet(folder)
        CS.run_search_stream(spark, folder, b.schema, root, answers, ckpt, chunks, videos)
    assert _counts(spark, root) == {"captain rocket": 3, "laser": 1}
    version = ST.read_version(spark, root, "query_cache").number
    for epoch, b in enumerate(batches):                                         # both epochs are run again
        CS.answer_epoch(spark, b, epoch, root, answers, chunks, videos, "search")
    assert ST.read_version(spark, root, "query_cache").number == version and _counts(spark, root)["captain rocket"] == 3
    out = {r.event_id: (r.status, r.source) for r in spark.read.parquet(answers).collect()}
    assert out[1] == out[2] == ("ok", "search") and out[4] == ("ok", "cache")
    assert out[3] == ("required", None) and out[6] == ("too_long", None) and len(out) == 6


def test_an_epoch_that_failed_before_its_commit_is_done_again(spark):
    chunks, videos, ask = _search_case(spark)
    root, folder, answers, ckpt = (scratch_path(spark, x) for x in ("fail-store", "fail-in", "fail-out", "fail-ckpt"))
    requests = ask([(1, "captain rocket"), (2, "laser")])
    requests.write.parquet(folder)
    run = lambda: CS.run_search_stream(spark, folder, requests.schema, root, answers, ckpt, chunks, videos)
    with mock.patch.object(ST, "_commit", side_effect=IOError("down")), pytest.raises(Exception):
        run()
    assert ST.read_version(spark, root, "query_cache").number == 0
    run()
    assert _counts(spark, root) == {"captain rocket": 1, "laser": 1} and spark.read.parquet(answers).count() == 2


def test_rollup_stream_late_rows_restart_and_replay(spark):
    root, folder, ckpt = (scratch_path(spark, x) for x in ("roll-store", "roll-in", "roll-ckpt"))
    rows = [(i, T0 + dt.timedelta(hours=h), q, f"c{i}") for i, (h, q) in enumerate([(5, "Hi"), (6, "there"), (7, "hi!"), (0, "hi"), (900, "there"), (1, "late one")])]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, query string, chunk_id string")
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(folder)
        CS.run_rollup_stream(spark, folder, log.schema, root, ckpt)
    want = {tuple(r) for r in CA.cache_rollup(CA.with_normalized_query(log)).select(*(f.name for f in ST.QUERY_CACHE.fields)).collect()}
    assert {tuple(r) for r in ST.read_table(spark, root, "query_cache").collect()} == want and len(want) == 3
    version = ST.read_version(spark, root, "query_cache")
    CS.store_rollup(spark, root, "rollup", _entries(spark, ["hi"], 1), int(version.marks["epoch:rollup"]))
    assert ST.read_version(spark, root, "query_cache").number == version.number


def test_upsert_of_scripts_touches_their_videos_only(spark):
    root = scratch_path(spark, "scripts")
    videos = spark.createDataFrame([(f"v{i}", "old", f"u{i}", None, None) for i in range(60)], ST.VIDEOS)
    segments = spark.createDataFrame([(f"v{i}", 0, "old text", 0, 1) for i in range(60)], ST.SEGMENTS)
    ST.replace_table(videos, root, "videos")
    ST.replace_table(segments, root, "segments")
    before = ST.read_version(spark, root, "segments")
    listing = spark.createDataFrame([("v3", "new title", "u"), ("v99", "added", "u99")], "video_id string, title string, video_url string")
    choice = spark.createDataFrame([("v3", None, None, None, None, "stt"), ("v3", 0, "fresh", 0, 1, "stt"), ("v3", 1, "text", 1, 2, "stt"),
                                    ("v99", None, None, None, None, "subtitles")],
                                   "video_id string, pos long, text string, start_ms long, end_ms long, extraction_type string")
    FJ.upsert_scripts(spark, root, listing, choice)
    after = ST.read_version(spark, root, "segments")
    assert len(set(before.folders) - set(after.folders)) <= 2
    got = {r.video_id: (r.title, r.transcript) for r in ST.read_table(spark, root, "videos").collect()}
    assert got["v3"] == ("old", "freshtext") and got["v99"] == ("added", "") and got["v4"] == ("old", None) and len(got) == 61
    assert ST.read_table(spark, root, "segments").count() == 61


def _chunk_rows(spark, n):
    chunks = spark.createDataFrame([(f"c{i:03d}", f"text {i}") for i in range(n)], "chunk_id string, text string")
    return chunks.select("chunk_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in ST.CHUNKS.fields[1:4]), "text",
                         *(F.lit(None).cast(f.dataType).alias(f.name) for f in ST.CHUNKS.fields[5:]))


def test_backfill_scans_pending_rows_once_and_resumes_without_a_scan(spark):
    root, good = scratch_path(spark, "backfill"), EM.hashed_trigram_provider(4)
    ST.append_table(_chunk_rows(spark, 60), root, "chunks")
    real, planned, embedded = EM.pending, [], []
    with mock.patch.object(EM, "pending", side_effect=lambda *a: planned.append(1) or real(*a)), \
            mock.patch.object(FJ.EM, "embed_bucket", side_effect=_failing_at(2, EM.embed_bucket, embedded)):
        with pytest.raises(IOError):
            FJ.embed_stage(spark, root, good, commit_rows=10, pause_s=0.0)
    assert len(planned) == 1 and len(embedded) == 2
    kept = ST.read_table(spark, root, "chunk_vectors").count()
    assert 0 < kept < 60
    with mock.patch.object(FJ.EM, "embed_bucket", side_effect=_failing_at(99, EM.embed_bucket, embedded)):
        FJ.embed_stage(spark, root, good, commit_rows=10, pause_s=0.0)
    assert sorted(embedded) == sorted(set(embedded))                            # no bucket twice
    vectors = ST.read_table(spark, root, "chunk_vectors")
    assert vectors.count() == 60 == vectors.select("chunk_id").distinct().count()
    assert EM.open_runs(spark, f"{root}/_embed") == []


def _failing_at(n, real, done):
    def embed(spark, run, bucket, *a):
        if len(done) >= n:
            raise IOError("down")
        real(spark, run, bucket, *a)
        done.append((run, bucket))
    return embed


def test_time_spans_keep_their_sign(spark):
    values = [0, 1, -1, 61_000, -61_000, -86_400_000, -90_061_500, 90_061_500]
    df = spark.createDataFrame([(v,) for v in values], "ms long")
    from cuefind.functions.text import parse_timespan_ms
    rows = df.select("ms", ST.timespan_text("ms").alias("t")).withColumn("back", parse_timespan_ms(F.col("t"))).collect()
    assert all(r.ms == r.back for r in rows) and {r.ms: r.t for r in rows}[-61_000] == "-00:01:01"
