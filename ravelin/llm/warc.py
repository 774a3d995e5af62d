"""A content-addressed web archive: payloads once each, by SHA-256; exact record headers apart;
original records by a join on the digest.

An archive is a folder with two Parquet tables. `payloads` (digest, payload) holds each distinct
payload once, whatever the number of records; equal ones meet in each task before they are shuffled.
`headers` (page_id, url, digest, payload_bytes, record_type, refers_to, header, header_sha256) holds the header
block of every record as it stands in a WARC file, and its digest. Reading puts records together again, header,
payload and the two line ends after it, and compares both digests. Payloads are never dealt out by record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.shared import shared_dir

#: Payloads of fewer bytes are not worth a revisit record.
LEAST = 100
#: Payloads of more than MANY records, of at most MANY digests and BROADCAST bytes, are broadcast.
MANY, BROADCAST = 1000, 32 << 20
#: The profile of revisits of equal payloads, fixed by the WARC 1.1 specification.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(date: str) -> Column:
    """The header block, in the order of the WARC 1.1 specification's examples."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", page(F.col("page_id"))),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", page(F.col("refers_to")))).otherwise(""),
        line("WARC-Date", F.lit(date)),
        # A line break can't stand in a header; as in a URL it is percent-encoded. The column `url` has it as it was.
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))).otherwise(""),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive pages (page_id, url, html) below path.

    A null html is an empty payload. Of records with equal payloads of LEAST bytes at least, that with the
    smallest page_id is the response (repeated rows of it as well) and the others revisit it; smaller
    payloads are all responses. A null page_id is a response only if no other record has its payload. An empty table
    gives an empty archive; other columns of pages, whatever their names, are not read.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    records = base.select("page_id", "url", "digest", "payload_bytes")
    first = records.filter(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = records.join(first, "digest", "left").withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    typed = typed.withColumn("header", _header(date)).withColumn("header_sha256", F.sha2("header", 256))
    typed.select("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "header", "header_sha256").write.parquet(f"{path}/headers")
    base.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload_bytes, payload of each payload, read back. A payload that doesn't have its digest fails the read."""
    p = spark.read.parquet(f"{path}/payloads")
    again = F.sha2("payload", 256)
    checked = F.when(again == F.col("digest"), again).otherwise(F.raise_error(F.concat(F.lit("a stored payload is not that of "), F.col("digest"))))
    return p.select(checked.alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def records(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, digest, record_type, refers_to, record: the records put together by a join on the digest.

    whole: with the payload under every header, as crawled; else as a WARC file has them, revisits without a block. A record
    whose parts differ from those written fails the read.
    """
    h = spark.read.parquet(f"{path}/headers").withColumnRenamed("payload_bytes", "written_bytes")
    p = payloads(spark, path)
    # Payloads of very many records go to where those are, if they are no more than BROADCAST bytes.
    many = h.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("written_bytes").alias("size")).filter(F.col("n") > MANY)
    n, size = many.agg(F.count(F.lit(1)), F.sum("size")).first()
    if n and n <= MANY and size <= BROADCAST:
        hot = [r["digest"] for r in many.select("digest").collect()]  # at most MANY
        out = h.filter(~F.col("digest").isin(hot)).join(p.filter(~F.col("digest").isin(hot)), "digest").unionByName(h.filter(F.col("digest").isin(hot)).join(F.broadcast(p.filter(F.col("digest").isin(hot))), "digest"))
    else:
        out = h.join(p, "digest")
    body = F.col("payload") if whole else F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    same = (F.sha2("header", 256) == F.col("header_sha256")) & (F.col("written_bytes") == F.col("payload_bytes"))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))
    wrong = F.raise_error(F.concat(F.lit("a record of other bytes than written: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return out.select("page_id", "url", "payload_bytes", "digest", "record_type", "refers_to", F.when(same, record).otherwise(wrong).alias("record"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and record_bytes of each record, of the whole records as put together again."""
    r = records(spark, path)
    return r.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to a new archive in the shared folder and return its index."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return index(spark, path)
