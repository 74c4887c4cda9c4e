import pytest
from llm_plain import components, documents, jaccard_links, prose, shingles, words

import corpus_pipeline
from siteratio.llm import pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(160):
        good = i % 5 != 0
        text = prose(i, 70 + i % 60) + f" write to user{i}@mail.example.org now" if good else "junk!! " * (20 + i)
        rows.append((i, text, f"s{i % 3}"))
        labels.append((i, int(good), 0))
    rows += [(200 + i, rows[1 + 5 * i][1] + (" more" if i % 2 else ""), "s0") for i in range(8)]
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, dict((i, q) for i, q, _ in labels)


def test_each_stage_by_plain_python(spark, tables, tmp_path):
    path, rows, quality = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {i: t for i, t, _ in rows}
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram jaccard join", "pii", "mix sources", "best-fit packing"]
    for stage in out[:-1]:
        assert list(stage[0].asDict()) == COLUMNS
    good = {r["doc_id"] for r in out[0]}
    assert good == {i for i in texts if quality.get(i, 1)}
    sets = {i: shingles(texts[i]) for i in good}
    kept = set(components(jaccard_links(sets), sets).values())
    assert {r["doc_id"] for r in out[1]} == kept and len(out[1]) == len(kept) < len(good)
    assert {r["doc_id"]: r["text"] for r in out[2]} == {i: pii.blank(texts[i], pii.find(texts[i])) for i in kept}
    assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in out[2])
    taken = dict.fromkeys(kept, 0)
    for r in out[3]:
        taken[r["doc_id"]] += len(words(r["text"]))
    size = {r["doc_id"]: len(words(r["text"])) for r in out[2]}
    assert all(taken[i] <= 2 * size[i] for i in kept)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=64 * 6)
    pieces = out[4]
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for begin, n in sorted(own):
            assert begin == at
            at += n
        assert at <= 2048
    assert sum(r["start"] == 0 for r in pieces) == len(out[3])


def test_run_is_its_stages(spark, tables):
    path, _, _ = tables
    got = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 100 and corpus_pipeline.ORACLE_SQL is None
