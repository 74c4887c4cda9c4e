import os
import random

from siteratio.llm.components import components


def test_components_of_any_shape(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200 + i, 200) for i in range(1, 40)] + [(239, 260), (261, 260)]
    loose = [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    edges = [*chain, *star, *loose, (7, 7), (9, 8), (8, 9)]
    want: dict[int, int] = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in components(frame).collect()} == want
    assert components(frame.limit(0)).collect() == []


def test_stars_take_no_step(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    frame = spark.createDataFrame([(1 + 10 * k, 10 * k) for k in range(5)] + [(2, 0), (3, 0)], "a long, b long")
    assert len({r["component"] for r in components(frame).collect()}) == 5
    assert [n.split("-")[0] for n in set(os.listdir(root)) - before] == ["edges"]
