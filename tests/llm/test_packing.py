import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_plain import ODD, SCHEMA, documents, prose
from tokenizers import Tokenizer

from siteratio.llm import packing
from siteratio.llm.tokens import WordTokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(VOCABULARY)


def test_cached_ids_are_the_tokenizers(reference):
    own = WordTokenizer(VOCABULARY)
    rng = random.Random(5)
    signs = "aab's'Trveml dD123 .!?-\n\t\x1c\x85\xa0²éÉñßÀÿİŁǅ中‘’é가'"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["it's WE'VE 'some rock'n'roll ''s 's's", "<|endoftext|> a", prose(3, 400), ""]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, text


def plan_of(lengths, capacity=10):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    seats = {}
    for length, first, pieces, per, sequence, begin in packing.plan_runs(histogram, capacity):
        for k in range(pieces):
            assert (length, first + k) not in seats
            seats[length, first + k] = (sequence + k // per, begin + k % per * length)
    assert set(seats) == {(n, k) for n, c in histogram.items() for k in range(c)}
    held = {}
    for (length, _), (sequence, begin) in seats.items():
        held.setdefault(sequence, []).append((begin, length))
    for pieces in held.values():
        at = 0
        for begin, length in sorted(pieces):
            assert begin == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit(lengths, capacity=10):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_over_counts_is_best_fit():
    rng = random.Random(1)
    assert plan_of([]) == 0
    for _ in range(300):
        lengths = [rng.randint(1, 10) for _ in range(rng.randint(1, 60))]
        assert plan_of(lengths) == best_fit(lengths)


def check(rows, docs, reference, capacity=packing.CAPACITY):
    packed = packing.pack(docs, VOCABULARY).toPandas()
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    want = []
    for name, text, *_ in rows:
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            raw = ids[start : start + capacity].tobytes()
            want.append((-1 if name is None else name, k, start, len(raw) // 4, zlib.crc32(raw)))
    packed["doc_id"] = packed["doc_id"].fillna(-1).astype(int)
    got = packed[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all()
        assert own["length"].sum() <= capacity
    assert all(len(r) // 4 == n for r, n in zip(packed["ids"], packed["length"], strict=True))


def test_pieces_and_places(spark, reference):
    rows = [(i, prose(i, 10 + 37 * i % 1500)) for i in range(60)]
    check(rows, documents(spark, rows), reference)


def test_odd_rows(spark, reference):
    check(ODD, documents(spark, ODD), reference)
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_one_length_for_most_pieces(spark, reference, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    monkeypatch.setattr(packing, "CHUNK", 7)
    rows = [(i, "same words" if i % 4 else prose(i, 40)) for i in range(300)]
    check(rows, documents(spark, rows), reference)
