"""WARC records in a content-addressed archive.

Two Parquet datasets make an archive: ``payloads`` holds every distinct payload once, by its SHA-256,
and ``headers`` the exact header block of every record with the digest it points to. Reading joins
them by digest and gives back the records as they were, byte for byte. A digest is taken anew from
the stored bytes and records whose payload does not match are refused, so a damaged archive can't be
read as if it were whole.

Payload bytes cross the network once, when equal payloads are brought together; a payload held by a
third of all pages is first reduced inside each task. Everything else moves digests and headers.

Defined cases: a null html is the empty payload; a null url is written as an empty target; a null
page_id never is the smallest while another page has the payload, and rows that repeat the smallest
page_id with the same payload are all responses; an empty table makes an empty archive; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 100

#: WARC-Date of all records unless another is given, so that equal pages make equal archives.
DATE = "2000-01-01T00:00:00Z"

CRLF = "\\r\\n"


def payload_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary) and its SHA-256 in hex."""
    return pages.select(
        "page_id",
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def record_headers(keyed: DataFrame, date: str = DATE) -> DataFrame:
    """One header block per page, as response or as a revisit of the response with equal payload.

    ``keyed`` has page_id, url, digest and size (bytes of the payload). A record's ID is made of its page_id, url
    and digest and its number among the rows that have all of them alike.
    """
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = keyed.groupBy("digest").agg(F.min(named).alias("first"))
    firsts = firsts.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    counted = keyed.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("times"))
    keyed = counted.withColumn("number", F.explode(F.expr("sequence(1L, times)"))).drop("times")
    revisit = (F.col("size") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    typed = keyed.join(firsts, "digest").withColumn("revisit", revisit)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.expr(f"'{CRLF}'"))
    target = F.regexp_replace("url", "[\\r\\n]", "")
    page_text = lambda page: F.coalesce(page.cast("string"), F.lit(""))
    identity = lambda page, url, number: F.concat(
        F.lit("<urn:sha256:"),
        F.sha2(F.concat_ws(":", F.lit("page"), page_text(page), "digest", number.cast("string"), url), 256),
        F.lit(">"),
    )
    header = F.concat(
        F.expr(f"'WARC/1.1{CRLF}'"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", identity(F.col("page_id"), F.col("url"), F.col("number"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", identity(F.col("first_page"), F.col("first_url"), F.lit(1))),
                line("X-Refers-To-Page", F.col("first_page").cast("string")),
            ),
        ).otherwise(line("Content-Type", F.lit("text/html"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("X-Page", F.col("page_id").cast("string"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.expr(f"'{CRLF}'"),
    )
    return typed.select("digest", F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write the records of ``pages`` (page_id, url, html) below ``path``, all with the WARC-Date ``date``."""
    digested = payload_digests(pages)
    digested.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    keyed = digested.withColumn("size", F.octet_length("payload").cast("long")).drop("payload")
    record_headers(keyed, date).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, verified and with their headers read.

    Columns: page_id, record_type, refers_to, header (exact bytes), digest, stored_digest and
    payload_bytes (both from the stored bytes) and payload (the full payload; a revisit's is that of
    the record it refers to). A record without a stored payload, or with one that doesn't match its
    digest or length, raises.
    """
    # one file may hold a payload twice only if an attempt was written again; the digest makes them equal
    stored = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        F.sha2("payload", 256).alias("stored_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, f"(?dm)^{name}: ([^\\r\\n]*)", 1)
    headers = spark.read.parquet(f"{path}/headers").select(
        "header",
        F.regexp_extract(text, "WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
        F.nullif(field("X-Page"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.nullif(field("X-Refers-To-Page"), F.lit("")).cast("long").alias("refers_to"),
        field("X-Payload-Length").cast("long").alias("said_bytes"),
    )
    whole = (F.col("stored_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("said_bytes"))
    damaged = F.raise_error(F.concat(F.lit("archive lacks or damaged payload "), F.col("digest")))
    return (
        headers.join(stored, "digest", "left")
        .withColumn("stored_digest", F.when(whole, F.col("stored_digest")).otherwise(damaged))
        .drop("said_bytes")
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """Add ``record``: the record as one block of bytes, a revisit with its empty body."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.encode(F.expr(f"'{CRLF}{CRLF}'"), "UTF-8")
    return records.withColumn("record", F.concat(F.col("header"), body, end))
