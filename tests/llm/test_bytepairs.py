"""Token counts against the library that the vocabulary file belongs to."""

import random

import pytest
from llm_plain import ODD, documents

from siteratio.llm import bytepairs
from siteratio.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


PARTS = ["a", "e", "th", " ", "  ", "\n", "é", "ß", "中", "\U0001f600", "▁", "x", "1", "-", "of", "The", "\x00", "́"]
SPECIAL = ["", " ", "<s></s>", "<unk>", "<0x0A>", "▁x▁▁", "a  b ", " " * 300, "x" * 5000, "ab" * 3000, "﻿a", "\U0010ffff"]


def test_equals_library_on_odd_texts(library):
    rng = random.Random(1)
    texts = SPECIAL + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    counter = bytepairs.merge_counter(PIECES)
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_windows_and_forgotten_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "WINDOW", 40)
    monkeypatch.setattr(bytepairs, "KEPT_WORDS", 7)
    rng = random.Random(2)
    counter = bytepairs.MergeCounter(PIECES)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(100, 400)))
        assert counter.count(text) == len(library.encode(text))
        assert "".join(counter.windows(text)) == text
        assert len(counter.kept) <= 7 and len(counter.older) <= 7


def test_leftmost_of_equal_pairs_merges_first():
    """aaa: the pair to the left merges, the third letter stays alone."""
    counter = bytepairs.MergeCounter.__new__(bytepairs.MergeCounter)
    counter.rank = {"aa": 0, "aab": 1, "ab": 2}
    assert counter.merges("aaa") == 1
    assert counter.merges("aaab") == 2  # aa + ab
    assert counter.merges("aab") == 2  # aa, then aab
    assert counter.merges("a") == 0 and counter.merges("") == 0


def test_odd_rows(spark, library):
    docs = documents(spark, ODD)
    got = bytepairs.count_tokens(docs, PIECES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in ODD)
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert bytepairs.count_tokens(docs.limit(0), PIECES).count() == 0


def test_query_equals_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_heap_bpe_counts"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
