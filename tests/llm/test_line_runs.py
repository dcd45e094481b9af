"""Line dedup against a brute-force version, the levels of the index, hot lines, clashing names."""
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from cuefind.llm import line_runs as lr

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def model(pairs):
    order = lambda i: (i is not None, i or 0)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = {}
    for i, text in pairs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    last = {k: max(ids, key=order) for k, ids in held.items() if len(ids) >= 3}
    for i, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def planted(seed, docs=80):
    rng = random.Random(seed)
    common = [f"Common Line Number {k} " + "é" * (k % 3) + "x" * rng.randrange(0, 8) for k in range(30)]
    style = [str.upper, str.lower, lambda x: f" \t{x}\r", lambda x: x]
    out = []
    for i in range(docs):
        lines = [rng.choice(style)(rng.choice(common)) if rng.random() < 0.5 else f"own line {seed} {i} {k}" + " word" * 4 for k in range(rng.randrange(0, 12))]
        out.append((rng.randrange(docs), "\n".join(lines)))
    return out


EDGES = [(1, "exactly twenty chars\nnineteen characters\n"), (2, "  EXACTLY twenty chars\r\nNINETEEN characters"), (3, "exactly TWENTY chars\nnineteen characters"),
         (4, "ÀÉÎ is no ascii letter"), (5, "àéî is no ascii letter"), (6, "àéî is no ascii letter"), (None, "exactly twenty chars"),
         (7, " exactly twenty chars"), (8, "a line in two documents only"), (9, "a line in two documents only"), (9, "\n\n"), (10, None), (11, "")]


def test_against_brute_force(make_docs, awkward):
    pairs = awkward + EDGES + planted(1) + planted(2) + [(1000 + i, "THE very same line for all\nown\n" * 3) for i in range(60)]
    got = Counter(map(tuple, lr.rows(make_docs(pairs)).collect()))
    assert got == Counter(model(pairs))


def test_empty_table_and_one_batch(make_docs):
    assert lr.rows(make_docs([])).collect() == [] and lr.clean(make_docs([])).count() == 0
    pairs = planted(3)
    assert Counter(map(tuple, lr.rows(make_docs(pairs), batches=1).collect())) == Counter(model(pairs))


def test_levels_are_compacted_and_settled_keys_not_rewritten(spark, tmp_path):
    runs = lr.LineRuns(spark, str(tmp_path / "runs"), fanout=3)
    counts = Counter()
    for b in range(9):
        rows = [(bytes([k]) * 16, 100 * b + d) for k in range(6) for d in range(k)] + [(bytes([100 + b]) * 16, 5000 - b)]
        counts.update(k for k, _ in rows)
        runs.add(spark.createDataFrame(rows + rows, "digest binary, doc_id long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    merged = {bytes(r["digest"]): (r["n_docs"], r["last_doc"]) for r in runs.runs()[0].collect()}
    assert merged.keys() == counts.keys() and all(merged[bytes([k]) * 16] == (9 * k, 800 + k - 1) for k in range(1, 6))
    before = runs.runs()[0].count()
    runs.add(spark.createDataFrame([(bytes([5]) * 16, 3), (bytes([1]) * 16, 9000)], "digest binary, doc_id long"))
    newest = spark.table(runs.levels[0][-1]).collect()
    assert [bytes(r["digest"])[0] for r in newest] == [1] and runs.runs()[1].count() == before      # 5 is settled
    assert {bytes(r["digest"])[0]: r["last_doc"] for r in runs.repeated().collect()}[1] == 9000
    runs.close()


def test_runs_are_joined_without_being_shuffled(spark, tmp_path):
    runs = lr.LineRuns(spark, str(tmp_path / "runs"))
    for b in range(2):
        runs.add(spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"), F.lit(b).cast("long").alias("doc_id")))
    plan = lr.LineRuns._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_plan_has_no_python(make_docs):
    plan = lr.rows(make_docs(planted(4, 10)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_takes_any_other_columns(spark):
    line = "the same line in all the documents"
    names = "doc_id long, text string, _row string, _key int, _lines int, _gone array<int>, digest string, line int, batch int, n_chars int"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", "r", 1, 2, [3], "d", i, 0, 0) for i in (1, 2, 3)], names)
    out = lr.clean(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "own 1" and got[2]["text"] == "own 2" and got[3]["text"] == f"{line}\nown 3"
    assert got[1]["n_chars"] == 5 and all(got[i][2:9] == ("r", 1, 2, [3], "d", i, 0) for i in got)
