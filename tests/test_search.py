"""Hand cases for the search, hybrid, cache and admission operators."""

from pyspark.sql import functions as F

from cuefind.functions.text import normalize_text
from cuefind.operators import admission as AD
from cuefind.operators import cache as CA
from cuefind.operators import hybrid as HY
from cuefind.operators import search as SE
from models import normalize_model, trigram_sim

CH_SCHEMA = "chunk_id string, video_id string, text string, normalized_text string, start_ms long, " \
            "embedding array<float>"


def _chunks(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>")
    return df.select("chunk_id", F.lit("v").alias("video_id"), "text",
                     normalize_text(F.col("text")).alias("normalized_text"),
                     F.lit(0).cast("long").alias("start_ms"), "embedding")


import pytest


@pytest.mark.parametrize("ratio", [10 ** 9, 0, 200])
def test_trigram_topk_matches_full_scan(spark, monkeypatch, ratio):
    monkeypatch.setattr(SE, "PAIR_TO_FMA", ratio)   # huge: 0/1 blocks; 0: pair by pair
    texts = ["the quick brown fox", "quick brown", "lazy dog", "", "fox", "brown fox jumps", "zzz", "ab\U00020000cd"]
    chunks = _chunks(spark, [(f"c{i}", t, None) for i, t in enumerate(texts)])
    asked = [(1, "Quick fox!"), (2, "qqq"), (3, ""), (4, "ab\U00020000")]
    got = {}
    for r in SE.trigram_topk(chunks, spark.createDataFrame(asked, "query_id long, query string"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, round(r.score, 9)))
    for qid, q in asked:
        scored = sorted(((-trigram_sim(normalize_model(t), normalize_model(q)), f"c{i}")
                         for i, t in enumerate(texts)))[:5]
        exp = [(rank + 1, cid, round(-s, 9)) for rank, (s, cid) in enumerate(scored)]
        assert sorted(got[qid]) == exp, qid   # zero scores fill up to k, ties by chunk id


def test_vector_topk_zero_vector_last(spark):
    chunks = _chunks(spark, [("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 0.0]), ("c", "x", [0.7, 0.7]),
                             ("d", "x", None)])
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.rank, r.chunk_id) for r in SE.vector_topk(chunks, queries, k=5).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "c"), (3, "b")]   # zero vector: null distance, ranked last; null skipped


def test_vector_rank_is_not_rounded(spark):
    """Distances that differ by less than 1e-6 keep their order; equal vectors tie by chunk id."""
    base = [1.0, 1e-4, 0.0]
    chunks = _chunks(spark, [("z", "x", base), ("y", "x", [1.0, 1.2e-4, 0.0]), ("a", "x", [1.0, 3e-4, 0.0]), ("b", "x", base)])
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = [r.chunk_id for r in SE.vector_topk(chunks, queries, k=4).orderBy("rank").collect()]
    assert got == ["b", "z", "y", "a"]


def test_other_dimensions_are_an_error(spark):
    chunks = _chunks(spark, [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.0, 0.0])])
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="do not have 2 dimensions"):
        SE.vector_topk(chunks, queries, k=5).collect()
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        SE.vector_topk(chunks, mixed, k=5)


def test_hybrid_prefers_common_then_trigram_rank(spark):
    merged = spark.createDataFrame(
        [(1, "A", 0.9, 1, None, None), (1, "B", 0.8, 2, 0.99, 1), (1, "Z", None, None, 0.5, 2),
         (2, "C", 0.5, 1, None, None), (2, "D", 0.4, 2, None, None), (2, "Y", None, None, 0.9, 1)],
        "query_id long, chunk_id string, trigram_score double, trigram_rank int, vector_score double, vector_rank int")
    best = {r.query_id: (r.chunk_id, r.similarity_score, r.is_common) for r in HY.hybrid_best(merged).collect()}
    assert best == {1: ("B", 0.8, True), 2: ("C", 0.5, False)}
    assert [r.chunk_id for r in HY.hybrid_common(merged).collect()] == ["B"]
    avg = HY.hybrid_scores(merged).first().avg_score
    assert abs(avg - (0.8 + 0.99) / 2) < 1e-12


def test_admission(spark):
    q = spark.createDataFrame([(1, "  "), (2, "a" * 64), (3, "a" * 65), (4, None), (5, "Hello"),
                               (6, "\U0001F600" * 32), (7, "\U0001F600" * 33)], "key int, query string")
    got = {r.key: (r.status, r.query) for r in AD.admit(q).collect()}
    assert got[1] == ("required", None) and got[4] == ("required", None)
    assert got[2][0] == "ok" and got[3] == ("too_long", None) and got[5] == ("ok", "hello")
    assert got[6][0] == "ok" and got[7][0] == "too_long"   # length counted in UTF-16 units


def test_result_links(spark):
    df = spark.createDataFrame([("https://www.youtube.com/watch?v=abcDEF123-_", 61900)],
                               "video_url string, start_ms long")
    r = AD.result_links(df).first()
    assert r.timestamp == 61 and r.link.endswith("&t=61")
    assert r.embed_url == "https://www.youtube.com/embed/abcDEF123-_?start=61"
    assert r.thumbnail_url == "https://img.youtube.com/vi/abcDEF123-_/hqdefault.jpg"


def test_cache_roundtrip_and_dangling(spark):
    log = spark.createDataFrame([
        (1, "2024-01-01 00:00:00", "Hi There!", "c1"), (2, "2024-01-01 00:01:00", "hi there", "c2"),
        (3, "2024-01-01 00:02:00", "other", "gone")], "event_id long, ts string, query string, chunk_id string")
    log = CA.with_normalized_query(log.withColumn("ts", F.to_timestamp("ts")))
    cache = CA.cache_rollup(log)
    rows = {r.normalized_query: r for r in cache.collect()}
    assert rows["hi there"].chunk_id == "c1" and rows["hi there"].access_count == 2
    queries = spark.createDataFrame([(10, "hi there"), (11, "other"), (12, "new")],
                                    "query_id long, normalized_query string")
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    res = {r.query_id: (r.hit, r.resolved) for r in CA.cache_resolve(CA.cache_lookup(queries, cache), chunks).collect()}
    assert res == {10: (True, True), 11: (True, False), 12: (False, False)}
    delta = CA.cache_rollup(log.where("event_id = 3"))
    up = {r.normalized_query: r.access_count for r in CA.cache_upsert(cache, delta).collect()}
    assert up == {"hi there": 2, "other": 2}


def _random_case(spark, seed=7):
    import random
    rng = random.Random(seed)
    words = ["quote", "rocket", "captain", "laser", "anger", "spear", "x1", "zz"]
    rows = []
    for i in range(80):
        text = None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        vec = None if i % 11 == 0 else [0.0] * 3 if i % 13 == 0 else [rng.uniform(-1, 1) for _ in range(3)]
        rows.append((f"c{i:02d}", text, vec))
    df = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>")
    chunks = df.select("chunk_id", "text", normalize_text(F.col("text")).alias("normalized_text"), "embedding")
    asked = [(q, " ".join(rng.choice(words) for _ in range(q % 4)), None if q % 5 == 0 else [rng.uniform(-1, 1) for _ in range(3)])
             for q in range(23)]
    return chunks, spark.createDataFrame(asked, "query_id long, query string, embedding array<float>")


def _rows(df):
    return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_one_group_and_many_groups_and_tiles(spark, monkeypatch):
    """The same rows however the queries are grouped, the work is tiled or the chunks are dealt."""
    chunks, queries = _random_case(spark)
    one = _rows(SE.search(chunks, queries, 4))
    assert len(one) > 100
    monkeypatch.setattr(SE, "GROUP_BYTES", 300)             # a few queries per group
    assert len(SE.query_groups(queries, True, True)[0]) > 5
    assert _rows(SE.search(chunks, queries, 4)) == one
    monkeypatch.setattr(SE, "TILE_CELLS", 8)
    monkeypatch.setattr(SE, "TILE_PAIRS", 20)
    assert _rows(SE.search(chunks.repartition(5), queries, 4)) == one


def test_both_sides_at_once_equal_each_alone(spark):
    chunks, queries = _random_case(spark, 8)
    both = SE.search(chunks, queries, 5)
    assert _rows(both.where("side = 0").drop("side")) == _rows(SE.trigram_topk(chunks, queries, 5))
    assert _rows(both.where("side = 1").drop("side")) == _rows(SE.vector_topk(chunks, queries, 5))


def test_winners_carry_their_payload(spark):
    chunks = _chunks(spark, [(f"c{i}", t, None) for i, t in enumerate(["red fox", "blue fox", "red hen", ""])])
    queries = spark.createDataFrame([(1, "red"), (2, "fox")], "query_id long, query string")
    res = [tuple(r) for r in SE.trigram_topk(chunks, queries, k=2, payload=("text", "start_ms"))
           .select("query_id", "rank", "chunk_id", "text", "start_ms").collect()]
    # "fox" vs "red fox": 4 shared of 8 trigrams; vs "blue fox": 4 of 9
    assert {(r[0], r[3]) for r in res if r[1] == 1} == {(1, "red fox"), (2, "red fox")}


def test_whole_corpus_and_long_ids(spark, tmp_path):
    """Documents without a vector are searched too; ids of nine digits and more stay apart."""
    from cuefind.sources import testdata as TD
    d = str(tmp_path)
    spark.createDataFrame([(123456789, "alpha beta", "s"), (123456780, "gamma delta", "s"), (5, "alpha", "s")],
                          "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    corpus = TD.document_corpus(spark, d)
    assert corpus.count() == 3 and corpus.where("embedding is null").count() == 2
    assert corpus.select("video_id").distinct().count() == corpus.select("chunk_id").distinct().count() == 3
    long_id = spark.createDataFrame([(10 ** 15 + 1,), (10 ** 15 + 2,)], "conv_id long")
    assert {r[0] for r in long_id.select(TD.video_id_of("conv_id")).collect()} == {str(10 ** 15 + 1), str(10 ** 15 + 2)}


def test_long_turns_do_not_overlap(spark, tmp_path):
    from cuefind.sources import testdata as TD
    d = str(tmp_path)
    spark.createDataFrame([(1, 0, "w " * 1199 + "w"), (1, 1, "next turn"), (1, 5000, "far turn")],
                          "conv_id long, turn int, text string").write.parquet(f"{d}/conversations.parquet")
    pos = [r.pos for r in TD.conversation_segments(spark, d).orderBy("pos").collect()]
    assert pos == list(range(1204))


def test_cached_search_flow(spark):
    """Hits count up, misses are inserted, dangling entries replaced; each request counts once."""
    import datetime as dt
    from cuefind.session import scratch_path
    from cuefind.sources import store as ST
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    root = scratch_path(spark, "cached-search")
    chunks = _chunks(spark, [("c1", "captain rocket flies", [1.0, 0.0]), ("c2", "laser spear", [0.0, 1.0])])
    videos = spark.createDataFrame([("v", "Title", "https://www.youtube.com/watch?v=abcdefghijk")],
                                   "video_id string, title string, video_url string")
    ST.replace_table(spark.createDataFrame(
        [("captain rocket", "c2", t(0), t(1), 4), ("old one", "gone", t(0), t(0), 1), ("untouched", "c1", t(0), t(0), 9)],
        ST.QUERY_CACHE), root, "query_cache")
    asked = [(1, t(10), "Captain, ROCKET!", None), (2, t(11), "captain rocket", [1.0, 0.0]), (3, t(12), "old one", None),
             (4, t(13), "laser spear", [0.0, 1.0]), (5, t(14), "  ", None), (6, t(15), "x" * 65, None)]
    requests = spark.createDataFrame(asked, "event_id long, ts timestamp_ntz, query string, embedding array<float>")
    out = {r.event_id: r for r in CA.cached_search(spark, root, requests, chunks, videos).collect()}
    assert out[1].source == out[2].source == "cache" and out[1].chunk_id == "c2" and out[1].similarity_score == 1.0
    assert out[3].source == "search" and out[4].chunk_id == "c2" and out[4].link.endswith("&t=0")
    assert (out[5].status, out[6].status) == ("required", "too_long") and out[5].chunk_id is None
    table = {r.normalized_query: (r.chunk_id, r.created_at, r.last_accessed_at, r.access_count)
             for r in ST.read_table(spark, root, "query_cache").collect()}
    assert table["captain rocket"] == ("c2", t(0), t(11), 6) and table["untouched"] == ("c1", t(0), t(0), 9)
    assert table["old one"] == (out[3].chunk_id, t(0), t(12), 2) and table["laser spear"] == ("c2", t(13), t(13), 1)
    assert len(table) == 4


def test_search_by_text_uses_the_provider_for_queries(spark):
    from cuefind.operators import embed as EM
    provider = EM.hashed_trigram_provider(16)
    texts = ["captain rocket flies", "laser anger spear", "galactic readings", "rocket rocket"]
    raw = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    vecs = EM.embed_texts(raw, provider, pause_s=0.0)
    chunks = raw.join(vecs, "chunk_id").select(
        "chunk_id", "text", normalize_text(F.col("text")).alias("normalized_text"), "embedding")
    queries = spark.createDataFrame([(1, "Laser anger spear"), (2, "readings")], "query_id long, query string")
    best = {r.query_id: (r.chunk_id, r.is_common) for r in HY.search_by_text(chunks, queries, provider, pause_s=0.0).collect()}
    assert best[1] == ("c1", True)       # same text: trigram rank 1 and vector rank 1
    assert best[2][0] == "c2"


def test_no_query_row_passes_the_driver(spark, monkeypatch):
    """Groups, parts and blocks of a few rows: the same result, and neither collect nor broadcast of the query side."""
    chunks, queries = _random_case(spark)
    one = _rows(SE.search(chunks, queries, 4))
    monkeypatch.setattr(SE, "GROUP_BYTES", 300)
    monkeypatch.setattr(SE, "PART_GROUPS", 2, raising=False)
    monkeypatch.setattr(SE, "BLOCK_BYTES", 500, raising=False)

    def refused(*a, **k):
        raise AssertionError("the query side passes the driver")

    collect = type(queries).collect
    with monkeypatch.context() as m:
        m.setattr(type(queries), "collect", lambda df: refused() if "query_id" in df.columns else collect(df))
        m.setattr(type(spark.sparkContext), "broadcast", refused)
        found = SE.search(chunks, queries, 4)
    assert _rows(found) == one
