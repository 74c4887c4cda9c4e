import numpy as np
from llm_plain import components

from siteratio.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, bucket string, links long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(3)


def clustered(seed, groups, near, alone, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(near):
            rows.append((centre + rng.normal(size=dim) * 0.09, g % 3))
    rows += [(rng.normal(size=dim), int(rng.integers(0, 3))) for _ in range(alone)]
    return [(i * 2, [float(np.float32(v)) for v in x], label) for i, (x, label) in enumerate(rows)]


def brute(rows):
    usable = [
        (i, np.array(x, dtype=np.float64), label)
        for i, x, label in rows
        if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)
    ]
    links = []
    for k, (i, x, a) in enumerate(usable):
        for j, y, b in usable[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((i, j))
    return links


def test_links_and_components(spark, monkeypatch):
    rows = clustered(1, 12, 15, 150) + [(1001, clustered(1, 12, 15, 0)[0][1], 0)]
    want = brute(rows)
    for block in (embed.BLOCK, 4):  # also with buckets split into many blocks
        monkeypatch.setattr(embed, "BLOCK", block)
        got = {r["vec_id"]: r for r in embed.near_vectors(vectors(spark, rows)).collect()}
        found = sum(r["n_links"] for r in got.values()) / 2
        assert 0.95 * len(want) <= found <= len(want) and len(want) > 300
        of = components(want, [i for i, *_ in rows])
        assert np.mean([got[i]["component_id"] == of[i] for i in of]) > 0.98
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_and_nothing_below_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows, want = [], 0
    for k in range(300):  # pairs at cosines from 0.96 to 1
        x = rng.normal(size=32)
        y = rng.normal(size=32)
        y -= x * (x @ y) / (x @ x)
        c = 0.96 + 0.04 * k / 300
        z = c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows += [(2 * k, [float(np.float32(v)) for v in x], 1), (2 * k + 1, [float(np.float32(v)) for v in z], 1)]
    want = {i for i, _ in brute(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(vectors(spark, rows)).collect()}
    found = {i for i in got if i % 2 == 0 and got[i]}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1),
        (8, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [5.0, 5.0], 3), (12, [1.0, -0.0], 1),
    ]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed.near_vectors(vectors(spark, rows)).collect()), key=str)
    want = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
    want += [(8, 4, 8), (8, 4, 8), (9, 4, 8), (12, 4, 8), (None, 4, 8), (None, 0, None)]
    assert got == sorted(want, key=str)
    assert embed.near_vectors(vectors(spark, [])).collect() == []


def linked(spark, rows, schema):
    got = embed.near_vectors(spark.createDataFrame(rows, schema)).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}


def test_doubles_stay_doubles(spark):
    def pair(cosine):
        return [1.0, 0.0], [cosine, float(np.sqrt(1 - cosine * cosine))]

    (a, below), (_, above) = pair(0.98 - 1e-11), pair(0.98 + 1e-11)
    rows = [(1, a, 1), (2, below, 1), (11, a, 2), (12, above, 2), (21, [1e300, 1e300], 3), (22, [1e300, 1e300], 3),
            (23, [1e-60, 1e-60], 3), (24, [5e-324, 5e-324], 3), (25, [-1e300, 1e300], 3)]
    got = linked(spark, rows, "vec_id long, embedding array<double>, label int")
    assert got[1] == (0, 1) and got[2] == (0, 2)
    assert got[11] == (1, 11) and got[12] == (1, 11)
    assert [got[i] for i in (21, 22, 23, 24)] == [(3, 21)] * 4 and got[25] == (0, 25)


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], "y"), (4, [1.0, 0.0], None)]
    assert linked(spark, rows, "vec_id long, embedding array<float>, label string") == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_pairs_of_blocks_across_batches(spark, monkeypatch):
    rows = clustered(3, 6, 40, 60)
    want = sum(r["n_links"] for r in embed.near_vectors(vectors(spark, rows)).collect())
    monkeypatch.setattr(embed, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sum(r["n_links"] for r in embed.near_vectors(vectors(spark, rows)).collect()) == want > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
