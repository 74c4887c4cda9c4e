import hashlib
import random
import re

from llm_plain import ODD, SCHEMA, documents
from pyspark.sql import functions as F

from siteratio.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for alphabet in ("a1@.+ -()9é0%", "0123456789. -", "+1 (5)-.09", "ab@.c-\U0001f600"):
        for _ in range(6000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == base(text), text


def test_spans_behind_cues():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t) if k not in pii.BASE_KINDS]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 and more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert kinds('token = "8f40a6af40009d6a"') == [("secret", "8f40a6af40009d6a")]
    assert kinds("Password:hunter2hunter, a password manager") == [("secret", "hunter2hunter")]
    assert kinds("tokens = abcdefgh1") == [] and kinds("mytoken=abcdefgh1") == []
    assert kinds("SSN 123-45-6789, ssn 000-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("account number: 1234-5678 90") == [("account", "1234-5678 90")]
    assert kinds("see https://bob:pw@host.org:80/x and https://host.org") == [("url", "https://bob:pw@host.org:80")]
    assert kinds("an account of tokens and passwords with a secret") == []


def test_long_runs_are_linear():
    assert pii.find("a" * 300_000) == [] and pii.find("1" * 300_000) == []
    assert pii.find("1." * 150_000)[:1] == [("ip", 0, 7)]
    assert [s[0] for s in pii.find("a" * 300_000 + "@b.c")] == ["email"]


def test_query_columns(spark):
    from siteratio.llm.pii import find_spans, span_text

    rows = [(1, "a@b.de \U0001f600 +1 (607) 555-1595"), (2, "nothing")]
    found = find_spans(documents(spark, rows)).select("doc_id", span_text(F.col("spans")).alias("spans"))
    assert {r["doc_id"]: r["spans"] for r in found.collect()} == {1: "email:0:6,phone:9:26", 2: ""}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_redaction(spark):
    rows = [(1, "mail a@b.de or 4539 1488 0343 6467!"), (2, None), (3, "clean"), (3, "clean")]
    got = pii.redact(documents(spark, rows))
    assert got.columns == documents(spark, rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [
        (1, "mail <EMAIL> or <CARD>!"), (2, ""), (3, "clean"), (3, "clean"),
    ]
    assert pii.blank("0123456789", [("ip", 1, 5), ("card", 3, 8)]) == "0<IP>89"


def test_odd_rows(spark):
    got = pii.find_spans(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["spans"] == [] for r in got)
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_counts_and_digest(spark, tmp_path):
    from siteratio.llm import queries

    texts = ["a@b.de 10.0.0.1 a@b.de, +1 (607) 555-1595", "4539 1488 0343 6467 or 256.1.1.1", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op7(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans = base(text or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_phone"], got[1]["n_card"]) == (2, 1, 1, 1)
