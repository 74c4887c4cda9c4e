import random

import numpy as np
import pytest
from llm_plain import ODD, SCHEMA, components, documents, jaccard_links, prose, shingles

from siteratio.llm import jaccard
from siteratio.llm.words import mix


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**9)}"
    return " ".join(w)


def near_rows():
    rows = []
    passage = prose(77, 60)
    for base in range(12):
        text = prose(base, 40 + 60 * base)
        rows.append(text)
        for k in range(6):
            rows.append(edited(text, 1 + k * (1 + base // 4), base * 100 + k))
        rows.append(text)
    rows += [prose(500 + i, 40) + " " + passage for i in range(90)]
    hub = prose(900, 130)
    rows += [edited(hub, 1 + i % 9, i) for i in range(120)]
    rows += [edited(rows[-1], 2, i) for i in range(10)]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def check(rows, got):
    sets = {i: shingles(t) for i, t in rows}
    want = components(jaccard_links(sets), sets)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    return want


def test_components_as_by_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = documents(spark, rows)
    want = check(rows, jaccard.jaccard_components(docs).collect())
    assert 30 < len(set(want.values())) < len(rows) - 60
    monkeypatch.setattr(jaccard, "COMMON", 3)  # nearly every shared signature counts as common
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 25)
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 512)
    check(rows, jaccard.jaccard_components(docs).collect())
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_family_without_its_text(spark, monkeypatch):
    # copies of very different length around the threshold, few of them linked; every pair must come up in some block
    text = prose(41, 400).split()
    rows = []
    for i in range(90):
        rng = random.Random(i)
        cut = text[rng.randrange(0, 60) : 400 - rng.randrange(0, 60)]
        rows.append((i, edited(" ".join(cut), 4 + i % 7, i)))
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 9)
    want = check(rows, jaccard.jaccard_components(documents(spark, rows)).collect())
    assert 5 < len(set(want.values())) < 85


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 8, 15, 16, 40, 100, 255, 256, 700, 2100):
        for _ in range(6):
            pool = mix(rng.integers(1, 2**62, 2 * n + 4).astype(np.uint64))
            a = pool[:n]
            # as different as the threshold allows: drop some, add some
            drop = int(rng.integers(0, n // 7 + 1))
            add = next(k for k in range(n, -1, -1) if 100 * (n - drop) >= 75 * (n + k))
            b = np.concatenate([a[drop:], pool[n : n + add]])
            band = max(len(a), len(b)).bit_length() - 1
            one, part = jaccard.signatures(np.sort(a), band)
            two, _ = jaccard.signatures(np.sort(b), band)
            same = len(set(part[one == two]))
            assert same >= max(jaccard.sure_matches(len(x), band) for x in (a, b) if 4 * len(x) // 3 >= 1 << band) >= 1


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(5)
    for n in (1, 20, 33, 64, 65, 300, 1025):
        pool = np.unique(mix(rng.integers(1, 2**62, 2 * n).astype(np.uint64)))
        for share in (0.0, 0.1, 0.4):
            b = np.concatenate([pool[: int(n * (1 - share))], pool[n : n + int(n * share * 0.5)]])
            one, two = sorted((jaccard._sketch(pool[:n]), jaccard._sketch(b)), key=len)
            while len(two) > len(one):
                two = two[: len(two) // 2] ^ two[len(two) // 2 :]
            bits = sum(int(x).bit_count() for x in (one ^ two).view(np.uint64))
            assert bits <= len(set(pool[:n].tolist()) ^ set(b.tolist()))


def test_threshold_is_exact(spark):
    # 3 of 4 shingles: exactly 0.75 links; 5 of 7 does not
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u v w x y"), (4, "p q r s t u v w x z z")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert len(got) == len(ODD)
    by_id = {i: (n, c) for i, n, c in got if i is not None}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[4] == (1, 4)
    assert by_id[6][1] == 6 and by_id[7][1] == 6
    assert sorted(c is None for i, _, c in got if i is None) == [True, True]
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 6, None, None, 8, 9], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.keep_one(empty).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_connected_components(spark, shape):
    from siteratio.llm.components import components as connected

    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(40)], "none": []}[shape]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges, {x for e in edges for x in e})
