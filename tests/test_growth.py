"""What keeps the queries' cost in proportion to their input: bounded numbers of jobs, packed intermediate tables, all cores
at work, and the short ways of text functions, which give what the long ones give."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuefind.functions import text as TX
from cuefind.operators import chunking as CH
from cuefind.operators import embed as EM
from cuefind.operators import postings as PO
from cuefind.operators import search as SE
from cuefind.session import scratch_path, written
from cuefind.sources import fixture_files as FF
from models import normalize_model


def _texts(n, seed):
    rng, letters = random.Random(seed), "abzAZ09 \t\n.,_-'$+éÉłŁıİßΣςﬁ漢\U00020000́בבּᅡ "
    return ["".join(rng.choice(letters[:15] if i % 3 else letters) for _ in range(rng.choice([0, 1, 4, 30, 90]))) for i in range(n)]


def test_a_written_result_is_packed(spark):
    """embed_apply, chunk queries: kept rows are Parquet files, not serialized rows."""
    rows = spark.createDataFrame([(1, "a", [1.0]), (None, None, None)], "k long, t string, v array<float>")
    kept = written(rows)
    assert kept.inputFiles() and kept.schema == rows.schema
    assert sorted(kept.collect(), key=str) == sorted(rows.collect(), key=str)
    seg = spark.createDataFrame([("v", i, "word", i, i + 1) for i in range(9)], "video_id string, pos long, text string, start_ms long, end_ms long")
    assert CH.chunk_segments(seg).inputFiles()


def test_buckets_of_a_backfill_are_bounded(spark):
    """fetch_job: many pending rows are not many small runs one after the other."""
    rows = spark.range(400).select(F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("text"))
    run = EM.plan_backfill(rows, scratch_path(spark, "work"), 10, 4)
    assert len(EM.run_buckets(spark, run)) == 4
    assert spark.read.parquet(run).select("chunk_id").distinct().count() == 400


def test_words_of_a_text_are_looked_up_once():
    """embed_pending: the provider remembers a word's trigrams; equal words give equal vectors."""
    provide = EM.hashed_trigram_provider(16)
    vectors = {d["index"]: d["embedding"] for d in provide(["one two", "two  ONE one", "", None, "\U00020000 ß"])}
    assert vectors[0] == vectors[1] and vectors[2] == vectors[3] == [0.0] * 16
    assert abs(sum(x * x for x in vectors[4]) - 1) < 1e-12
    want = [0.0] * 16
    for gram in ("  a", " ab", "ab "):
        want[(ord(gram[0]) * 961 + ord(gram[1]) * 31 + ord(gram[2])) % 16] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert provide(["ab"])[0]["embedding"] == [x / norm for x in want]


def test_trigrams_coded_outside_the_jvm(spark, monkeypatch):
    """trigram_topk and all hybrid searches: texts cross to Python, lists of trigram strings do not."""
    texts = _texts(300, 1) + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    rows = df.select("id", TX.word_text(F.col("t")).alias("w"), TX.trigrams(F.col("t")).alias("g")).orderBy("id").collect()
    code, start = PO.codes_of_words([r.w for r in rows])
    name = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0))
    for i, r in enumerate(rows):
        got = [name(c) for c in code[start[i]:start[i + 1]].tolist()]
        assert len(got) == len(set(got)) and set(got) == set(r.g or [])
    monkeypatch.setattr(PO, "SLICE_BYTES", 50)
    packed = {r.id: r.grams for r in PO.coded_grams(df, "t").collect()}
    assert packed[300] is None and all(set(np.frombuffer(packed[i], np.int64).tolist()) == set(code[start[i]:start[i + 1]].tolist()) for i in range(300))


def test_short_ways_of_the_normalizer(spark):
    texts = _texts(400, 2)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.normalize_text(F.col("t")).alias("n")).collect()
    assert all(r.n == normalize_model(r.t) for r in got)


def test_both_ways_of_time_spans(spark):
    """segments_json_roundtrip: the usual form is cut by position."""
    spans = ["00:00:00", "23:59:59.9999999", "01:02:03.5", "01:02:03.0420", "24:00:00", "00:60:00", "1:02:03", "1.02:03:04", "-00:00:01.5", "00:00:01\n",
             " 00:00:01", "00:00:01.", "00:00:01.12345678", "٠0:00:00", "", "x", None]
    rows = spark.createDataFrame([(s,) for s in spans], "s string").select(
        TX.parse_timespan_ms(F.col("s")).alias("ms"), TX._any_timespan_ms(F.col("s")).alias("want")).collect()
    assert [r.ms for r in rows] == [r.want for r in rows] and [r.ms for r in rows[:4]] == [0, 86399999, 3723500, 3723042]


def test_subtitle_files_are_written_by_all_cores(spark, tmp_path):
    seen = []
    frame = type(spark.range(0))
    plain = frame.repartition
    frame.repartition = lambda self, n, *cols: (seen.append(n), plain(self, n, *cols))[1]
    try:
        FF.write_subtitles(spark, "/root/testdata/sf0.001", str(tmp_path / "s"))
    finally:
        frame.repartition = plain
    assert FF.FILE_TASKS * spark.sparkContext.defaultParallelism in seen


def test_shared_trigrams_by_product_and_pair_by_pair_at_once(monkeypatch):
    """hybrid_common, hybrid_scores: a product is paid only for the trigrams that many chunks and queries have."""
    rng = np.random.default_rng(3)
    held = [np.unique(np.minimum(rng.zipf(1.3, 40), 60)) for _ in range(30)]
    asked = [np.unique(np.minimum(rng.zipf(1.3, 40), 60)) for _ in range(25)]
    codes = np.unique(np.concatenate(held))
    members = [np.flatnonzero([c in set(h.tolist()) for h in held]) for c in codes]
    segment = PO.Segment(0, 60, np.arange(30), np.array([len(h) for h in held]), codes, np.cumsum([0, *map(len, members)]), np.concatenate(members))
    vocab, code = np.unique(np.concatenate(asked), return_inverse=True)
    of = np.repeat(np.arange(25), [len(a) for a in asked])
    want = np.array([[len(set(h.tolist()) & set(a.tolist())) for a in asked] for h in held])
    widths = []
    for ratio in (0, 3, 10 ** 9):
        monkeypatch.setattr(SE, "PAIR_TO_FMA", ratio)
        plain = SE.places
        monkeypatch.setattr(SE, "places", lambda a, b, plain=plain: (widths.append((ratio, len(a))), plain(a, b))[1])
        assert (SE._shared(segment, segment.find(vocab), code, of, 25) == want).all()
        monkeypatch.setattr(SE, "places", plain)
    assert len([r for r, _ in widths if r == 3]) == 2          # one product and one count


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_is_shuffled_to_its_rows(spark):
    """embed_pending: rows are shuffled once, by text, and leave with their vector."""
    rows = spark.createDataFrame([(f"c{i}", f"text {i % 9}") for i in range(90)], "chunk_id string, text string")
    plan = _physical(EM.embed_texts(rows, EM.hashed_trigram_provider(4), pause_s=0.0))
    assert "Join" not in plan and "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("MapInArrow") < plan.index("Exchange")


def test_rows_of_a_text_over_many_batches(spark):
    """embed_pending: a frequent text is sent once though its rows fill many batches; nulls and repeated ids keep their rows."""
    sent = spark.sparkContext.accumulator(0)

    def provider(texts):
        sent.add(len(texts))
        return [{"index": i, "embedding": [float(len(t)) if t is not None else -1.0, 1.0][:1 + (t != "b")]} for i, t in enumerate(texts)]

    rows = [(i, "hot") for i in range(50)] + [(i, "b") for i in range(40, 60)] + [(None, "b"), (None, None), (7, None), (8, ""), (None, "lone")]
    df = spark.createDataFrame(rows, "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = EM.embed_texts(df, provider, id_col="query_id", pause_s=0.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, {None: [-1.0, 1.0], "b": [1.0]}.get(t, [float(len(t or "")), 1.0])) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.query_id, list(r.embedding))) for r in got)
    assert sent.value == 5


def test_vectors_are_sorted_after_their_shuffle_only(spark):
    """embed_apply: ids hardly ever come twice, so no sort goes before the shuffle of the vectors."""
    chunks = spark.createDataFrame([("a", None), ("b", [2.0]), ("c", None), ("c", None)], "chunk_id string, embedding array<float>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [9.0]), ("c", [3.0]), ("c", [3.0])], "chunk_id string, embedding array<float>")
    out = EM.apply_embeddings(chunks, vectors)
    assert sorted((r.chunk_id, r.embedding[0]) for r in out.collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0)]
    assert all("Aggregate" not in part.split("Exchange")[0] for part in _physical(out).split("REPARTITION_BY_COL")[1:])
    assert "REPARTITION_BY_COL" in _physical(out)


def test_code_points_are_numbered_without_a_sort(monkeypatch):
    """chunk_trigram_topk: the texts' characters are looked up in a table; only the trigrams are sorted."""
    words = ["ab", None, "b\x01\U00020000c", ""]
    want = [{(32, 32, 97), (32, 97, 98), (97, 98, 32)}, set(), {(32, 32, 98), (32, 98, 32), (32, 32, 0x20000), (32, 0x20000, 99), (0x20000, 99, 32)}, set()]
    monkeypatch.setattr(np, "unique", None)
    code, start = PO.codes_of_words(words)
    got = [[(c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) for c in code[a:b].tolist()] for a, b in zip(start[:-1], start[1:])]
    assert got == [sorted(x) for x in want]


def _some_segments(rng, count):
    out = []
    for s in range(count):
        held = [np.unique(rng.zipf(1.4, rng.integers(1, 60)) % 97) for _ in range(int(rng.integers(1, 30)))]
        codes = np.unique(np.concatenate(held))
        members = [np.flatnonzero([c in h for h in held]) for c in codes]
        sizes = np.array([len(h) for h in held])
        ids = np.array([f"s{s}-{i}" for i in range(len(held))], dtype=object)
        out.append(PO.Segment(int(sizes.min()), int(sizes.max()), ids, sizes, codes, np.cumsum([0, *map(len, members)]), np.concatenate(members)))
    return out


def _sets(segments):
    out = {}
    for s in segments:
        assert (np.diff(s.codes) > 0).all() and s.low == s.sizes.min() and s.high == s.sizes.max()
        for code, a, b in zip(s.codes.tolist(), s.starts[:-1], s.starts[1:]):
            for m in s.members[a:b].tolist():
                out.setdefault(s.ids[m], set()).add(code)
        assert all(len(out[i]) == n for i, n in zip(s.ids, s.sizes))
    return out


def test_merged_segments_hold_the_same_chunks():
    """hybrid_common, hybrid_scores: many short segments become few long ones."""
    segments = _some_segments(np.random.default_rng(5), 12)
    few = PO.merged(segments)
    assert len(few) < len(segments) and _sets(few) == _sets(segments)
    assert _sets(PO.merged(segments[:1])) == _sets(segments[:1])


def test_cells_below_a_kth_score_are_not_worked_out(monkeypatch):
    """chunk_trigram_topk: once a query has k chunks, only shared counts that can beat them are turned into scores."""
    rng = np.random.default_rng(6)
    segments = PO.merged(_some_segments(rng, 8), 30) + _some_segments(rng, 8)
    asked = [np.unique(rng.zipf(1.4, 30) % 97) for _ in range(40)] + [np.zeros(0, np.int64)]
    vocab, code = np.unique(np.concatenate(asked), return_inverse=True)
    sizes = np.array([len(a) for a in asked])
    group = SE.QueryGroup(np.arange(41), sizes, vocab, code, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(0, np.int64), np.zeros((0, 0)))
    sets, worked = {}, []
    for n, s in enumerate(segments):
        s.ids = np.array([f"{n}-{i}" for i in s.ids], dtype=object)
        sets |= _sets([s])
    plain = SE._candidates
    monkeypatch.setattr(SE, "_candidates", lambda key, *a: (worked.append(key.size), plain(key, *a))[1])
    top = SE._TopK(41, 3)
    SE._score_segments(segments, group, top)
    for q, a in enumerate(asked):
        score = lambda i: len(sets[i] & set(a.tolist())) / len(sets[i] | set(a.tolist()))  # noqa: B023,E731
        want = sorted(((-score(i), i) for i in sets))[:3]
        assert [(k, c) for k, c in zip(top.key[top.q == q].tolist(), top.chunk[top.q == q].tolist())] == want
    assert sum(worked) < 0.5 * 41 * len(sets)
