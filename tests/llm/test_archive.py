import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siteratio.llm import archive

SCHEMA = "page_id long, url string, html string, digest string, payload string, size long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


BIG, UTF = "<p>" + "a" * 200, "é" * 50 + "\r\n\r\nWARC/1.1\r\nX-Page: 77"
ROWS = [
    (5, "http://h/5", BIG), (2, "http://h/2", BIG), (9, None, BIG), (3, "u\r\nX-Page: 1", "small"),
    (1, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u X-Page: 8", UTF), (8, "u", UTF), (None, "u", BIG),
]


def test_round_trip(spark, tmp_path):
    archive.write_archive(pages(spark, ROWS), str(tmp_path))
    records = archive.record_bytes(archive.read_archive(spark, str(tmp_path))).collect()
    got = {r["page_id"]: r for r in records}
    assert len(records) == len(ROWS)
    for page, _, html in ROWS:
        raw = (html or "").encode()
        row = got[page]
        assert bytes(row["payload"]) == raw and row["payload_bytes"] == len(raw)
        assert row["stored_digest"] == hashlib.sha256(raw).hexdigest()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        revisit = len(raw) >= 100 and page != min(same)
        assert (row["record_type"], row["refers_to"]) == (("revisit", min(same)) if revisit else ("response", None))
        head, body = bytes(row["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == (b"" if revisit else raw) + b"\r\n\r\n"
        assert f"Content-Length: {0 if revisit else len(raw)}".encode() in head
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 4


def test_a_damaged_payload_is_refused(spark, tmp_path):
    archive.write_archive(pages(spark, ROWS), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    for name, bad in (("lost", stored.where(F.length("payload") < 200)), ("turned", stored.withColumn("payload", F.reverse(F.col("payload").cast("string")).cast("binary")))):
        bad.write.parquet(str(tmp_path / name / "payloads"))
        spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / name / "headers"))
        with pytest.raises(PySparkException):
            archive.read_archive(spark, str(tmp_path / name)).collect()


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    archive.write_archive(pages(spark, [ROWS[1], ROWS[1], ROWS[0]]), str(tmp_path / "twice"))
    got = archive.read_archive(spark, str(tmp_path / "twice")).select("page_id", "record_type").collect()
    assert sorted(map(tuple, got)) == [(2, "response"), (2, "response"), (5, "revisit")]
    archive.write_archive(pages(spark, []), str(tmp_path / "none"))
    assert archive.read_archive(spark, str(tmp_path / "none")).collect() == []


def test_mandatory_headers_and_record_ids(spark, tmp_path):
    rows = [*ROWS, ROWS[1], (2, "http://other", BIG), (2, "http://h/2", "x" * 150), (None, "u", BIG), (None, "v", "small")]
    archive.write_archive(pages(spark, rows), str(tmp_path))
    records = archive.read_archive(spark, str(tmp_path)).collect()
    assert len(records) == len(rows)
    heads = []
    for r in records:
        lines = bytes(r["header"]).decode().split("\r\n")[1:-2]
        heads.append((r, dict(x.split(": ", 1) for x in lines)))
    ids = {h["WARC-Record-ID"]: r for r, h in heads}
    assert len(ids) == len(rows)
    for r, h in heads:
        assert h["WARC-Date"] == archive.DATE
        assert ("Content-Type" in h) == (r["record_type"] == "response")
        if r["record_type"] == "revisit":
            first = ids[h["WARC-Refers-To"]]
            assert (first["page_id"], first["digest"], first["record_type"]) == (r["refers_to"], r["digest"], "response")
