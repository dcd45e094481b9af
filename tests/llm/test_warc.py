"""The archive: digests, revisits, exact records, damage."""
import hashlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from cuefind.llm import warc_store

PAGES = [(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (3, None, "x" * 150), (3, None, "x" * 150),
         (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/\r\nEvil: 1", None), (7, "", ""),
         (8, "http://f/", "é" * 50), (9, "http://f/", "é" * 50), (10, "http://g/", "a\r\n\r\nWARC/1.1\r\n" * 20),
         (None, "http://n/", "n" * 200), (11, "http://n/", "n" * 200)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    pages = spark.createDataFrame([(*p, "clash", 5) for p in PAGES], "page_id long, url string, html string, digest string, payload_bytes int")
    warc_store.write_archive(pages, path)
    return path


def model():
    first = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in PAGES:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != i else None
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers


def test_table(spark, archive):
    got = Counter(tuple(r) for r in warc_store.archive_table(spark, archive).collect())
    assert got == Counter(model())


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({p[2] or "" for p in PAGES})


def test_records_are_exact(spark, archive):
    rows = warc_store.reconstruct(spark, archive).collect()
    assert len(rows) == len(PAGES)
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        length = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and b"Evil" not in fields
        assert block[length:] == b"\r\n\r\n" and bytes(r["payload"]) == texts[r["page_id"]]
        assert block[:length] == (b"" if r["record_type"] == "revisit" else texts[r["page_id"]])


def test_damage_is_found(spark, archive, tmp_path):
    import pyspark.sql.functions as F
    bad = str(tmp_path / "bad")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{bad}/records")
    (spark.read.parquet(f"{archive}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
     .write.parquet(f"{bad}/payloads"))
    with pytest.raises(PySparkException):
        warc_store.archive_table(spark, bad).collect()


def test_empty(spark, tmp_path):
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc_store.archive_table(spark, str(tmp_path / "none")).count() == 0


def test_wrong_length_and_missing_payload_are_found(spark, archive, tmp_path):
    """The table comes from rebuilt records: a wrong Content-Length and a lost payload raise."""
    import pyspark.sql.functions as F
    for name, header, keep in (("length", F.regexp_replace("header", "Content-Length: 150", "Content-Length: 151"), "true"),
                               ("lost", F.col("header"), "length(payload) <> 150")):
        bad = str(tmp_path / name)
        spark.read.parquet(f"{archive}/records").withColumn("header", header).write.parquet(f"{bad}/records")
        spark.read.parquet(f"{archive}/payloads").where(keep).write.parquet(f"{bad}/payloads")
        with pytest.raises(PySparkException):
            warc_store.archive_table(spark, bad).collect()
