"""Bench: run the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; print one JSON line.

Each query is fully executed with the no-op sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hybrid_best",          # flagship: trigram + vector top 5, best per query, shaped
    "trigram_topk",         # inverted-index trigram search over whole documents
    "vector_topk",          # exact cosine top 5
    "chunk_segments",       # overlapping chunks from timed word segments
    "chunk_trigram_topk",   # chunking + trigram search over the chunks
    "cached_search",        # cache roll-up, lookup, resolve, search the misses
    "normalize_text",       # normalizer over all documents
    "subtitle_segments",    # subtitle files written then parsed
    "embed_pending",        # embedding backfill over all chunks
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from cuefind.plans.catalog import QUERIES
    from cuefind.session import drop_scratch, local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    # warm-up (not timed): JVM code paths and the Python workers, as a long-running
    # service would have them; touches no bench table
    spark.range(100_000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    spark.range(10_000, numPartitions=int(cpus)).mapInPandas(lambda it: it, "id long").count()
    tiny = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(tiny) and os.path.abspath(tiny) != os.path.abspath(sf_dir):
        # code-path warm-up on the tiny tables (different data, not timed)
        QUERIES["hybrid_best"](spark, tiny).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # keep measuring the rest; report the failure
            errors[name] = repr(exc)[:300]
            print(f"bench: {name} failed: {exc!r}", file=sys.stderr)
    sf = sf_dir.rsplit("sf", 1)[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
