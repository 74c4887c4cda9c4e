"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_plain import ODD, documents

from siteratio.llm import variants
from siteratio.llm.queries import QUERIES


def plain_counts(rows, every=97):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_near(words):
    """Near words through all variants of one edit that are themselves words."""
    letters = sorted({c for w in words for c in w})
    out = {}
    for w in words:
        others = {w[:k] + w[k + 1 :] for k in range(len(w))}
        others |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        others |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        out[w] = [o for o in others if o != w and o in words]
    return out


def plain(words):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def vocabulary(seed, n, letters="abéx", low=5, high=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = variants.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert collected(got) == plain(plain_counts(ODD))
    assert variants.spelling_variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [(20_000, 100_000, 48), (40, 60, 4), (3, 5, 1)])
def test_equals_all_pairs(spark, monkeypatch, cells):
    """Small cells: words cross many cuts, and cells that cannot be cut are dealt out in blocks."""
    for name, value in zip(("CELL", "ASKED", "LEAF"), cells, strict=True):
        monkeypatch.setattr(variants, name, value)
    rng = random.Random(5)
    vocab = vocabulary(4, 500, "abc") + vocabulary(6, 100, "aé", 5, 7) + ["ab" * 30 + "a" * k for k in range(5)]
    rows = [(k, " ".join(rng.choices(vocab, k=60)) + "!" + "—".join(rng.choices(vocab[:30], k=90)), "s") for k in range(60)]
    words = spark.createDataFrame([(w, n, len(w)) for w, n in plain_counts(rows).items()], "word string, n long, length int")
    near = {r.word: (r.n_near, r.form, r.form_n) for r in variants.near_words(words).collect()}
    counts = plain_counts(rows)
    best = {}
    for w, others in plain_near(counts).items():
        if others:
            top = min(others, key=lambda o: (-counts[o], o))
            best[w] = (len(others), top, counts[top])
    assert near == best
    assert collected(variants.spelling_variants(documents(spark, rows))) == plain(counts)


def test_windows_and_partial_sums_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "WINDOW", 16)
    text = "Straße ÀÉÿ abc×def x" + "y" * 100 + " 中naïve中 ÄäÖ-öÜ\n" * 9 + "z" * 40
    found = [w.decode() for window in variants.runs(text) for w in window]
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    assert found == re.findall("[A-Za-zÀ-ÿ]+", lowered)
    monkeypatch.setattr(variants, "HELD", 2)
    rows = [(k, text, "s") for k in range(200)]
    got = {r.word: r.n for r in variants.word_counts(documents(spark, rows)).collect()}
    assert got == plain_counts(rows)


def test_one_edit():
    assert variants.one_edit("abcde", "abXde") and variants.one_edit("abcde", "abcdX")
    assert variants.one_edit("abcd", "abXcd") and variants.one_edit("abcd", "abcdX") and variants.one_edit("abcd", "Xabcd")
    assert not variants.one_edit("abcde", "abcde") and not variants.one_edit("abcde", "aXcdX")
    assert not variants.one_edit("abcd", "acbdX")


def test_chains_are_followed(spark):
    n = 40
    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(n)], "word string, form string")
    got = {r.word: r.root for r in variants.follow(forms).collect()}
    assert got == {f"w{k:02}": f"w{n:02}" for k in range(n)}
    assert variants.follow(forms.limit(0)).count() == 0


def test_query_equals_plain(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op11_kd_spelling"](spark, sf_dir)
    assert dict(got.dtypes)["n_near"] == "bigint" and dict(got.dtypes)["form_n"] == "bigint"
    assert collected(got) == plain(plain_counts(rows))
