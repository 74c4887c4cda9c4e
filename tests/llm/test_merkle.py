"""The manifest against plain trees."""

import hashlib
import zlib

import pytest
from llm_plain import ODD, documents

from siteratio.llm import merkle
from siteratio.llm.queries import QUERIES


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([digest("".join(a[k : k + 3])) for k in range(0, len(a), 3)])
    return levels


def way(levels, i):
    out = []
    for a in levels[:-1]:
        run = a[i - i % 3 : i - i % 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def plain(rows):
    """Expected rows from dictionaries of documents."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, hashed, r) in enumerate(groups[s]):
            path = way(trees[s], i) + way(top, k)
            now = hashed
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            if hit and r["text"] is not None:
                now = leaf(r, r["text"].replace("\n", ""))
            for left, right in path:
                now = digest(left + now + right)
            proof = digest("".join(a + b for a, b in path))
            root = top[-1][0]
            out.append((str(r["doc_id"]), hashed, trees[s][-1][0], root, proof, now, now == root))
    return sorted(out)


def got(docs):
    found = merkle.manifest(merkle.document_leaves(docs, merkle.without_newlines()))
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def dicts(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4), (9, 10, 27, 28), (729, 730, 1), (1500,)])
def test_equals_plain_trees(spark, sizes):
    rows = [
        (k * 37 % 100_003 * (-1 if k % 5 == 0 else 1), f"t\n{k}" if k % 3 else "t", f"s{g}")
        for g, n in enumerate(sizes)
        for k in range(g * 2000, g * 2000 + n)
    ]
    docs = documents(spark, rows)
    assert got(docs) == plain(dicts(docs))


def test_three_passes(spark, monkeypatch):
    """Small blocks: several passes above each other, also among the sources."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "WIDTH", 3)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 4)
    rows = [(k, f"{k}\n", f"s{'é' * (k % 11)}") for k in range(60)] + [(k, "x", None) for k in range(100, 130)]
    docs = documents(spark, rows)
    assert got(docs) == plain(dicts(docs))


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    want = plain(dicts(docs))
    assert got(docs) == want
    assert merkle.manifest(merkle.document_leaves(docs.limit(0))).count() == 0


def test_sparse_repeated_and_null_ids(spark, monkeypatch):
    """Ids at the ends of the range, ids with several contents, rows with thousands of copies."""
    monkeypatch.setattr(merkle, "COPIES", 16)
    rows = [(i, "a\nb", "s") for i in (-(2**63), 2**63 - 1, 0, 1, 63, 64, 65, -1, -64, -65)]
    rows += [(7, f"text {k}", "s") for k in range(50)] + [(8, "same\n", "s")] * 300
    rows += [(None, f"null {k % 4}", "s") for k in range(9)] + [(7, "other", "t")] * 2
    docs = documents(spark, rows)
    assert got(docs) == plain(dicts(docs))


def test_untouched_rows_verify(spark):
    docs = documents(spark, [(k, f"a\n{k}", "s") for k in range(20)])
    found = merkle.manifest(merkle.document_leaves(docs)).collect()
    assert len(found) == 20 and all(r.verified and r.folded_root == r.root for r in found)


def test_query_equals_plain(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = dicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    frame = QUERIES["op12_bitmap_merkle"](spark, sf_dir)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert frame.columns == names
    assert sorted((str(r[0]), *r[1:]) for r in frame.collect()) == plain(rows)
    assert 0 < sum(r[6] for r in frame.collect()) < len(rows)
