"""Content-addressed WARC archive: payloads once by digest, record headers apart, joined to read.

An archive folder holds two tables:

* ``payloads`` (digest, payload, parts): the bytes of every distinct payload, once, under their SHA-256.
* ``records`` (page_id, header, digest, part): the exact header block of every WARC record.

A payload with many copies is read by ``parts`` tasks: its records are dealt over that many parts when
they are written, ``PART_RECORDS`` to a part. Almost every payload has one part, and is not repeated.

``reconstruct`` joins them back to whole records (header, payload bytes, record end), and every
read recomputes the digest of the stored bytes: a payload that doesn't match its name raises.

Cases: a null html is an empty payload; payloads under ``REVISIT_MIN_BYTES`` are always
responses; of equal larger payloads the rows with the smallest page_id are responses (all rows
with that id, if the row repeats; all rows, if no copy has an id), the others revisit it; a null
url has no target header, line breaks in a url are percent-encoded; an empty table gives an
empty archive; other columns are not read. A payload shared by a third of all pages is stored
once: partial aggregation before the shuffle, salted joins and parts after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefind.llm.common import salted_join

REVISIT_MIN_BYTES = 100
#: Records of one payload that a task joins to it.
PART_RECORDS = 1024
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """``name: value`` with its line end; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:none>"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", _urn(F.col("refers_to"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` into the archive folder ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    parts = F.ceil(F.count("*") / PART_RECORDS).cast("int")
    (base.groupBy("digest").agg(F.min("payload").cast("binary").alias("payload"), parts.alias("parts"))
     .write.parquet(f"{path}/payloads"))
    heads = base.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    several = (heads.groupBy("digest")
               .agg(F.min(F.when(F.col("payload_bytes") >= REVISIT_MIN_BYTES, F.col("page_id"))).alias("_first"),
                    F.count("*").alias("_copies"), parts.alias("_parts"))
               .where("_copies > 1").drop("_copies"))
    heads = salted_join(heads, several, "digest", "page_id", "left").withColumn(
        "refers_to", F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first")))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")     # any dealing will do
    heads.select("page_id", _header(date).alias("header"), "digest", part.alias("part")).write.parquet(f"{path}/records")


def _verified(digest: Column, payload: Column) -> Column:
    """The digest of the bytes; a mismatch with the name they are stored under fails the job."""
    real = F.sha2(payload, 256)
    return F.when(real == digest, real).otherwise(
        F.raise_error(F.concat(F.lit("stored payload does not match its digest "), digest)).cast("string"))


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' fields, parsed from their header blocks: no payload is read."""
    rows = spark.read.parquet(f"{path}/records")
    return rows.select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("Content-Length", "([0-9]+)").cast("long").alias("content_length"),
        "header", "part")


def _fails(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce("digest", F.lit("none")))).cast("string")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record`` (header block, block, record end as bytes) and ``payload``: the full
    payload of revisits too, which a flat archive would have to seek for. ``payload_digest`` is computed
    on the rebuilt record (a revisit's on the payload it refers to); a record without payload, of
    another length than its Content-Length, or of another digest than its header names raises."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        "digest", "payload", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = read_headers(spark, path).join(stored.hint("merge"), ["digest", "part"], "left")
    revisit = F.col("record_type") == "revisit"
    head = F.col("header").cast("binary")
    rebuilt = joined.withColumn("record", F.concat(
        head, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(_END.encode())))
    block = F.substring(F.col("record"), F.octet_length(head) + 1, F.col("content_length").cast("int"))
    whole = F.octet_length("record") == F.octet_length(head) + F.col("content_length") + len(_END)
    checked = (F.when(F.col("payload").isNull(), _fails("no stored payload for digest "))
               .when(~F.coalesce(whole, F.lit(False)), _fails("record differs in length from its Content-Length, digest "))
               .otherwise(_verified(F.col("digest"), F.when(revisit, F.col("payload")).otherwise(block))))
    return rebuilt.select("page_id", "record_type", "refers_to", checked.alias("payload_digest"), "payload", "record")


def archive_table(spark: SparkSession, path: str) -> DataFrame:
    """The digest rows of ``op8``, from the reconstructed and checked records of an archive."""
    return reconstruct(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
