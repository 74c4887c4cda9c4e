import os

import pytest
from llm_plain import documents, prose
from pyspark.sql import functions as F

from siteratio.llm import jaccard, mix, packing
from siteratio.llm.queries import VOCABULARY
from siteratio.llm.store import CLEAN_SHUFFLES, stored, temporary


@pytest.fixture
def left(spark):
    """Names of the tables that were stored since and are still there."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    return lambda: sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before)


def test_temporary_tables_go_and_kept_ones_stay(spark, left):
    with temporary(spark):
        one = stored(spark.range(5), "one")
        with temporary(spark):
            two = stored(one, "two", keep=True)
            stored(one, "three")
        assert left() == ["one", "two"] and two.count() == 5
        four = stored(two, "four", keep=True)
    assert left() == ["four"] and four.count() == 5
    with pytest.raises(ZeroDivisionError), temporary(spark):
        stored(spark.range(5), "five")
        raise ZeroDivisionError
    assert left() == ["four"]


def test_shuffle_files_go_with_their_query(spark):
    shuffles = lambda: sum(
        f.startswith("shuffle_") and f.endswith(".data") for _, _, names in os.walk(root) for f in names
    )
    root = os.path.dirname(spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath())
    before, switch = shuffles(), spark.conf.get(CLEAN_SHUFFLES, "false")
    counts = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffles() <= before and spark.conf.get(CLEAN_SHUFFLES, "false") == switch
    assert counts.count() == 7


def test_jaccard_and_mix_leave_one_table_each(spark, left):
    rows = [(i, prose(i // 3, 60) + f" {i}", f"s{i % 3}") for i in range(60)]
    docs = documents(spark, rows)
    classes = jaccard._classes(docs)
    assert left() == ["classes"] and classes.count() == 60
    mix.mixed_texts(docs).collect()
    assert left() == ["classes", "draws", "placed"]


def test_only_one_shuffle_has_the_ids(spark):
    docs = documents(spark, [(i, prose(i, 20)) for i in range(20)])
    executed = packing.pack(docs, VOCABULARY)._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [k for k, line in enumerate(executed) if "FileScan" in line]
    assert any("ids#" in executed[k] for k in scans)
    windows = [k for k, line in enumerate(executed) if "Window" in line]
    ranked = [executed[next(j for j in scans if j > k)] for k in windows]  # what the ranks are made from
    assert ranked and not any("ids#" in line for line in ranked)
