import hashlib
import re

import pytest
from llm_plain import ODD, SCHEMA, documents, prose
from pyspark.sql import functions as F

from siteratio.llm import orderhash


def rows_in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def edit(text, following):
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check(spark, rows):
    got = {r["doc_id"]: r for r in orderhash.fingerprints(documents(spark, rows)).collect()}
    order = rows_in_order(rows)
    for k, (name, text, *_) in enumerate(order):
        following = order[(k + 1) % len(order)]
        row = got[name]
        assert row["n_chars"] == len(text or "")
        assert row["edited_sha256"] == hashlib.sha256(edit(text, following[1]).encode()).hexdigest(), name
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        same = row["fingerprint"] == got[following[0]]["fingerprint"]
        assert (row["near_next"] == 1) == same
    return got


def test_neighbours_over_all_seams(spark, monkeypatch):
    rows = [(i * i + 3, prose(i, 5 + i % 40)) for i in range(90)]
    check(spark, rows)
    monkeypatch.setattr(orderhash, "RANGE_ROWS", 4)
    check(spark, rows)
    check(spark, [(5, "alone in the table")])
    check(spark, [(5, "one"), (7, None)])


def parts_by_hand(spark, text):
    """The method in plain Python, with the engine's hash."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    runs = [tuple((w[i : i + orderhash.KMER] + [None] * 3)[: orderhash.KMER]) for i in range(max(1, len(w) - orderhash.KMER + 1))]
    seen, numbered = {}, []
    for k in runs:
        numbered.append((*k, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(numbered)], "at int, a string, b string, c string, n int")
    hashed = frame.select("at", F.xxhash64(F.xxhash64("a", "b", "c"), "n").alias("h")).collect()
    picked = []
    for p in range(orderhash.PARTS):
        own = sorted((r["h"], r["at"]) for r in hashed if r["h"] % orderhash.PARTS == p)[: orderhash.PICKED]
        picked.append([h for h, _ in sorted(own, key=lambda x: x[1])])
    frame = spark.createDataFrame([(i, *(x + [None, None])[:2], len(x)) for i, x in enumerate(picked)], "i int, a long, b long, n int")
    one = F.when(F.col("n") == 2, F.xxhash64("a", "b")).when(F.col("n") == 1, F.xxhash64("a"))
    return [r["p"] for r in frame.select("i", one.alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "x y z " * 30, prose(5, 200), "  lead\ttail \n"])
def test_parts_as_by_hand(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(orderhash.fingerprint("text").alias("p")).first()["p"] == parts_by_hand(spark, text)


def test_likeness_falls_with_edits_and_with_moves(spark):
    text = prose(8, 400)
    w = text.split()
    few, many = w.copy(), w.copy()
    for i in range(0, 400, 100):
        few[i] = "changed"
    for i in range(0, 400, 10):
        many[i] = "changed"
    moved = w[200:] + w[:200]
    frame = spark.createDataFrame([(text, " ".join(x)) for x in (w, few, many, moved)], "a string, b string")
    frame = frame.select(orderhash.fingerprint("a").alias("a"), orderhash.fingerprint("b").alias("b"))
    same, near, far, turned = (r[0] for r in frame.select(orderhash.likeness("a", "b")).collect())
    assert same == 1.0 and same > near > far and turned < 0.8


def test_no_python_in_the_plan(spark):
    plan = orderhash.fingerprints(documents(spark, [(1, "a b c d")]).repartition(1))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark):
    got = orderhash.fingerprints(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"]}
    assert prints[1] == prints[2] == prints[3] and prints[6] == prints[7]
    assert orderhash.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_seams_when_cuts_differ_from_call_to_call(spark, monkeypatch):
    rows = [(i * i + 3, prose(i, 5 + i % 40)) for i in range(90)]
    exact, calls = F.percentile_approx, []

    def drifting(col, shares, accuracy):
        calls.append(1)
        return exact(col, [s / len(calls) for s in shares], accuracy)

    monkeypatch.setattr(orderhash, "RANGE_ROWS", 4)
    monkeypatch.setattr(F, "percentile_approx", drifting)
    check(spark, rows)
    assert calls
