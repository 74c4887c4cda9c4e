import numpy as np
from llm_plain import ODD, SCHEMA, documents, prose, words
from pyspark.sql import functions as F

from siteratio.llm import mix


def test_targets_stop_at_twice_the_size():
    sizes, weights = [100, 10, 50], [3.0, 1.0, 2.0]
    got = mix.capped_targets(sizes, weights, 240)
    # 120, 40, 80: the second stops at 20, its excess goes 12 and 8 to the others
    assert got == [132.0, 20.0, 88.0]
    assert mix.capped_targets([0, 0], [3.0, 1.0], 0) == [0.0, 0.0]
    assert sum(mix.capped_targets([5, 500, 7], weights, 768)) == 768


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 65, 1000):
        index = np.arange(n)
        for key in (1, 99):
            got = mix.permuted(index, np.full(n, n), np.full(n, key, dtype=np.uint64))
            assert sorted(got) == list(range(n))
    assert (mix.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)) != np.arange(1000)).mean() > 0.9


def test_taken_words_meet_targets(spark):
    rows = [(i, prose(i, 20 + i * 7 % 90), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    docs = documents(spark, rows)
    first, again = (mix.taken_words(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert first.equals(again)
    assert list(first["size"]) == [len(words(t)) for _, t, _ in rows]
    assert (first["taken"] <= 2 * first["size"]).all()
    assert abs(first["taken"].sum() - 1.5 * first["size"].sum()) < 64 * 10
    first["source"] = [s for _, _, s in rows]
    for _, own in first.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 2 * mix.BLOCK
        assert (own["source_size"] == own["size"].sum()).all()


def test_shards_hold_a_multinomial_draw_of_blocks(spark):
    docs = documents(spark, [(i, prose(i, 500), f"s{i % 2}") for i in range(300)])
    _, pieces, plan = mix.mix(docs)
    got = pieces.groupBy("shard").agg({"length": "sum", "*": "count"}).toPandas()
    slots = pieces.select("shard", "source_no", "epoch", "block").distinct().groupBy("shard").count().toPandas()
    assert slots["count"].sum() == plan.slots.sum() and (slots["count"] <= mix.SLOTS).all()
    assert len(got) == -(-plan.slots.sum() // mix.SLOTS)


def test_slots_of_one_source_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mix, "SLOTS_A_TASK", 2048)
    docs = documents(spark, [(i, "a b c d " * 8000, "one") for i in range(60)])
    _, plan = mix.streams(docs, ())
    slots = mix.deal_slots(spark, plan)
    sizes = [r[1] for r in slots.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == plan.slots.sum() > 20 * mix.SLOTS
    assert len(sizes) > 6 and max(sizes) < sum(sizes) / 3
    assert slots.distinct().count() == sum(sizes)


def test_mixed_texts_are_stretches(spark):
    rows = [(i, prose(i, 30 + 40 * (i % 9)), "a" if i % 2 else "b") for i in range(80)]
    docs = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mix.taken_words(docs).collect()}
    texts = mix.mixed_texts(docs).collect()
    got = dict.fromkeys(taken, 0)
    whole = {i: t for i, t, _ in rows}
    for r in texts:
        got[r["doc_id"]] += len(words(r["text"]))
        assert " ".join(r["text"].split()) in whole[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert got == taken


def test_odd_rows(spark):
    got = mix.taken_words(documents(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert (got[got["size"] == 0]["taken"] == 0).all()
    assert mix.mixed_texts(documents(spark, ODD)).where("n_chars = 0").count() == 0
    assert mix.taken_words(spark.createDataFrame([], SCHEMA)).collect() == []
