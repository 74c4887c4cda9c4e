"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from siteratio.runtime import scratch_path

#: Spark setting that gives a query's shuffle files back when it has ended, not when the driver collects its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables stored in each open block of ``temporary``, the innermost last.
_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Columnar and compressed, so it takes less room than checkpointed rows; like those it cuts the
    lineage and is there when an executor is lost. With ``keep`` it outlives the ``temporary`` block
    that it is stored in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    blocks = _BLOCKS.get()[:-1] if keep else _BLOCKS.get()
    if blocks:
        blocks[-1].append(path)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, so nothing that is read later may come from them.

    What outlives the block is stored with ``keep``.
    """
    paths: list[str] = []
    token = _BLOCKS.set((*_BLOCKS.get(), paths))
    try:
        yield
    finally:
        _BLOCKS.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
