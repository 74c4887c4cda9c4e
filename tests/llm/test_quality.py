import zlib

import pytest
from llm_plain import ODD, SCHEMA, documents, prose

from siteratio.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def mixed(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 80 + i % 50) if good else ("junk!! " * (20 + i % 30) if i % 8 else "%%% $$$ aa### " * 40)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = mixed(240)
    got = quality.quality_scores(documents(spark, rows), spark.createDataFrame(labels, LABELS)).toPandas()
    assert len(got) == 240 and got["score"].between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]] == list(got["held_out"])
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    truth = dict((i, q) for i, q, _ in labels)
    out = got[got["held_out"]]
    assert (out["predicted"] == [truth[i] for i in out["doc_id"]]).mean() >= 0.95
    assert len(out) > 20


def test_labels_of_held_out_rows_do_not_train(spark):
    rows, labels = mixed(160)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    docs = documents(spark, rows)
    one, two = (
        quality.quality_scores(docs, spark.createDataFrame(x, LABELS)).toPandas().set_index("doc_id")["score"].sort_index()
        for x in (labels, turned)
    )
    assert one.to_numpy() == pytest.approx(two.to_numpy(), abs=1e-9)


def test_filter_keeps_rows_as_they_are(spark):
    rows, labels = mixed(120)
    docs = documents(spark, [*rows, (3, rows[3][1])])
    kept = quality.keep_good(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 2 and set(ids) == {i for i, q, _ in labels if q}


def test_odd_rows_and_labels(spark):
    docs = documents(spark, ODD)
    for labels in ([], [(6, 1, 0)], [(6, 1, 0), (4, 0, 0), (7, None, 0), (8, 5, 0), (99, 1, 0), (None, 1, 0)]):
        got = quality.quality_scores(docs, spark.createDataFrame(labels, LABELS)).toPandas()
        assert len(got) == len(ODD) and got["score"].between(0, 1).all()
    assert set(quality.quality_scores(docs, spark.createDataFrame([], LABELS)).toPandas()["score"]) == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality_scores(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_no_stage_of_the_filter_has_two_python_steps(spark, monkeypatch):
    rows, labels = mixed(40)
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(quality, "fit", lambda rows, real=quality.fit: plans.append(plan(rows)) or real(rows))
    kept = quality.keep_good(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    python = ("MapInArrow", "EvalPython", "MapInPandas")
    assert [sum(p.count(name) for name in python) for p in plans] == [0]  # fit adds up in Python itself
    assert sum(plan(kept).count(name) for name in python) == 1
    got = {r["doc_id"] for r in kept.collect()}
    assert got == {i for i, q, _ in labels if q}
