import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_plain import ODD, SCHEMA, documents, prose, words

from siteratio.llm import katz


def held(name):
    return name is not None and zlib.crc32(str(name).encode()) % 7 == 2


def brute(rows):
    texts = [(i, [*words(t), "</s>"]) for i, t, *_ in rows]
    training = [t for i, t in texts if not held(i)]
    count = Counter(w for t in training for w in t)
    total, distinct = sum(count.values()), len(count)
    single = lambda w: (count[w] + 1) / (total + distinct + 1)
    of_pair = Counter(p for t in training for p in zip(["<s>", *t[:-1]], t, strict=True))
    least = katz.CUTOFF
    kept = {p: c for p, c in of_pair.items() if c >= least}
    factor = katz.discounts(Counter(kept.values()), least)
    of_history = {**count, "<s>": len(training)}
    after = {p: factor.get(c, 1 - 0.5 / c) * c / of_history[p[0]] for p, c in kept.items()}
    two, one = defaultdict(float), defaultdict(float)
    for (h, w), p in after.items():
        two[h] += p
        one[h] += single(w)
    alpha = {h: (1 - two[h]) / (1 - one[h]) for h in two}

    def chance(h, w):
        return after[h, w] if (h, w) in after else alpha.get(h, 1.0) * single(w)

    for h in [*list(alpha)[:20], "never seen"]:  # exactly normalised, with one share for unseen words
        mass = sum(chance(h, w) for w in count) + alpha.get(h, 1.0) / (total + distinct + 1)
        assert mass == pytest.approx(1, abs=1e-9)
    out = []
    for i, t in texts:
        base = sum(math.log10(single(w)) for w in t)
        score = sum(math.log10(chance(*p)) for p in zip(["<s>", *t[:-1]], t, strict=True))
        out.append((i, held(i), len(t), sum(count[w] > 0 for w in t), total, base, score))
    return out


def check(rows, docs, most=katz.FREQUENT):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(map(tuple, katz.Model(docs, most).score(docs).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-11, abs=1e-9)
    return got


ROWS = [(i, prose(i % 25, 30 + i % 40) + " " + prose(i, 10)) for i in range(120)]


def test_scores_as_by_brute_force(spark):
    got = check(ROWS, documents(spark, ROWS))
    out = [r for r in got if r[1]]
    assert out and sum(r[6] for r in out) > sum(r[5] for r in out)


def test_rare_words_and_pairs_by_shuffles(spark):
    check(ROWS, documents(spark, ROWS), most=8)


def test_odd_rows(spark):
    check(ODD, documents(spark, ODD))
    check([(1, None)], documents(spark, [(1, None)]))
    empty = spark.createDataFrame([], SCHEMA)
    assert katz.Model(empty).score(empty).collect() == []


def test_no_training_texts(spark):
    name = next(i for i in range(100) if held(i))
    rows = [(name, "all held out")]
    got = katz.Model(documents(spark, rows)).score(documents(spark, rows)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)]


def test_frequent_pairs_broadcast_and_rare_ones_shuffled(spark):
    docs = documents(spark, ROWS)
    model = katz.Model(docs, most=60)
    least = model.frequent(model.pairs, 60)
    sizes = [model.pairs.where(c).count() for c in (f"c >= {least}", f"c < {least}")]
    assert least > model.least and 0 < sizes[0] <= 60 and sizes[1] > 0
    check(ROWS, docs, most=60)


def test_pairs_seen_once_are_counted_and_discounted(spark):
    model = katz.Model(documents(spark, ROWS))
    training = [[*words(t), "</s>"] for i, t in ROWS if not held(i)]
    of_pair = Counter(p for t in training for p in zip(["<s>", *t[:-1]], t, strict=True))
    got = {r["c"]: r["count"] for r in model.pairs.groupBy("c").count().collect()}
    assert got == Counter(of_pair.values()) and got[1] > 0
    once = next((h, w) for (h, w), c in of_pair.items() if c == 1 and h != "<s>" and w != "</s>")
    name = next(i for i in range(1000, 1100) if held(i))
    other = [(name, " ".join(once))]
    check([*ROWS, *other], documents(spark, [*ROWS, *other]))


def test_discounts_free_the_mass_of_pairs_seen_once():
    of_count = {1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 35}
    factor = katz.discounts(of_count, 1)
    assert all(0 < factor[c] < 1 for c in range(1, 6))
    assert sum(of_count[c] * c * (1 - factor[c]) for c in range(1, 6)) == pytest.approx(of_count[1])
    assert factor[1] == pytest.approx((0.6 - 0.21) / (1 - 0.21))
    assert katz.discounts({}, 1) == {c: 1 - 0.5 / c for c in range(1, 6)}


def test_places_of_hashes():
    rng = np.random.default_rng(3)
    top = np.uint64(2**64 - 1)
    for n in (0, 1, 2, 50, 3000):
        there = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        there = np.unique(np.concatenate([there, there[:5] + np.uint64(1)]))  # neighbours share all leading bits
        found, at = katz.Places(there)(np.concatenate([there, there + np.uint64(2), [top, np.uint64(0)]]))
        assert found[: len(there)].all() and (at[: len(there)] == np.arange(len(there))).all()
        assert not found[-2:].any() and not (found[len(there) : -2] & ~np.isin(there + np.uint64(2), there)).any()


def test_pairs_are_stored_once_and_by_their_counts(spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    docs = documents(spark, ROWS)
    model = katz.Model(docs, most=60)
    left = lambda: sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before)
    assert left() == ["gains", "pairs", "vocabulary"] and model.pairs.columns == ["h", "w", "c"]
    # only pairs with a rare word have stored gains; tokens meet pairs in parts
    common = model.pairs.where(katz._common(model.top, "h", "w")).count()
    assert 0 < model.rare.where(f"h <> {katz.NONE}").count() == model.pairs.count() - common
    model.score(docs).collect()
    assert left() == ["gains", "pairs", *["slice"] * katz.SLICES, "vocabulary"]


def test_pairs_are_added_up_by_sorting():
    rng = np.random.default_rng(5)
    codes = np.concatenate([np.arange(9), rng.integers(-(2**63), 2**63 - 1, 6)])  # numbers below and above the top, hashes
    for n in (0, 1, 4000):
        h, w, c = rng.choice(codes, n), rng.choice(codes, n), rng.integers(1, 5, n)
        for counts in (None, c):
            want = Counter()
            for i in range(n):
                want[int(h[i]), int(w[i])] += 1 if counts is None else int(c[i])
            got = katz._tally(h, w, counts, 7)
            assert len(got[0]) == len(want) and {(int(x), int(y)): int(z) for x, y, z in zip(*got, strict=True)} == want


def test_each_pair_is_counted_once_without_hash_tables(spark, monkeypatch):
    texts = [(i, " ".join(words(t)).upper() if i % 2 else t) for i, t in ROWS] + [(None, "a b a b"), (None, None), (300, "")]
    docs = documents(spark, texts).repartition(5)
    training = [[*words(t or ""), "</s>"] for i, t in texts if not held(i)]
    of_pair = Counter(p for t in training for p in zip(["<s>", *t[:-1]], t, strict=True))
    tokens = sum(map(len, training))
    hashed = katz.word_counts(docs)
    for most, at_once in ((8, 40), (katz.NUMBERED, 1 << 21)):  # rare words and many partial sums; numbers only
        monkeypatch.setattr(katz, "TALLIED", at_once)
        numbers, top, _ = katz.numbered(hashed, most)
        pairs = katz.pair_counts(docs, numbers, top, tokens)
        # sums of the texts' tasks meet in tasks of a bounded share of the tokens
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and plan.count("MapInArrow") == 2
        got = pairs.collect()
        assert len({(r["h"], r["w"]) for r in got}) == len(got) == len(of_pair)
        assert Counter(r["c"] for r in got) == Counter(of_pair.values())
        assert pairs.rdd.getNumPartitions() == max(4, -(-tokens // at_once))


def test_pairs_are_stored_in_blocks_of_a_bucket(spark):
    docs = documents(spark, ROWS)
    for most in (60, katz.FREQUENT):
        model = katz.Model(docs, most=most)
        pairs = model.pairs.collect()
        files = model.pairs.inputFiles()
        rows = spark.read.parquet(*files).collect()
        assert len(rows) < len(pairs) / 10  # a row for each bucket and kind, not for each pair
        buckets = model.tasks * katz.SLICES
        assert len(rows) <= 2 * buckets
        assert len({(r["h"], r["w"]) for r in pairs}) == len(pairs)
        seen = 0
        for bucket in {r["bucket"] for r in rows}:
            own = katz.unpacked(model.blocks.where(f"bucket = {bucket}")).toArrow()
            h, w = own["h"].to_numpy(), own["w"].to_numpy()
            assert (katz._buckets(h, w, buckets) == bucket).all()
            seen += len(h)
        assert seen == len(pairs)


def test_scores_with_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(katz, "TALLIED", 1500)
    monkeypatch.setattr(katz, "PIECE", 20)
    rows = [*ROWS, *ROWS[:9], *ROWS[:3], (None, "a b a b"), (None, "a b a b"), (None, None), (300, ""), (301, "never seen before " * 4)]
    docs = documents(spark, rows).repartition(3)
    for most in (60, katz.FREQUENT):
        check(rows, docs, most=most)


def test_packed_numbers_and_codes_come_back():
    rng = np.random.default_rng(7)
    for top in (0, 1, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**62):
        x = rng.integers(0, top, 50, endpoint=True)
        x[0] = top
        assert (katz._unpacked(pa.scalar(katz._packed(x)), 50) == x).all()
    assert len(katz._packed(np.ones(9, np.int64))) == 9 and len(katz._unpacked(pa.scalar(b""), 0)) == 0
    hashes = rng.integers(-(2**63), 2**63 - 1, 90)
    numbers = rng.integers(1, katz.NUMBERED + katz.FIRST, 90)
    for codes, common in ((hashes, False), (numbers, True)):
        h, w = katz._codes_unpacked(*map(pa.scalar, katz._codes_packed(codes, codes[::-1], common)), common)
        assert (h == codes).all() and (w == codes[::-1]).all()


def test_table_finds_only_its_pairs():
    rng = np.random.default_rng(9)
    hashes = np.concatenate([[katz.NONE, katz.END, katz.START], rng.integers(-(2**63), 2**63 - 1, 20)])
    for top, codes in ((25, np.arange(1, 25)), (None, hashes)):
        all_pairs = [(h, w) for h in codes for w in codes]
        h, w = np.array(all_pairs).T
        for n in (0, 1, 100):
            there = rng.permutation(len(h))[:n]
            base = None if top else there + 0.5
            gain, bases = katz.Table(h[there], w[there], there + 1.0, base, top)(h, w)
            want = np.zeros(len(h))
            want[there] = there + 1.0
            assert (gain == want).all()
            if bases is not None:
                assert (bases == np.where(want > 0, want - 0.5, 0.0)).all()
        others = np.array([9, 24] if top else [3, 77]), np.array([5, 5])  # the first 9 pairs have one history
        assert (katz.Table(h[:9], w[:9], np.ones(9), None if top else np.ones(9), top)(*others)[0] == 0).all()
