"""Session helpers: where durable intermediate data goes, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Most rows of names that are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siteratio-checkpoint-"))
    return sc.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Later reads see the very same bits, which matters wherever a computed double
    is used as a join key, and a lost executor costs no recomputation.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh output path inside the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df``, computed once, and broadcast if it has no more than ``max_rows`` rows.

    For short lists of names beside a wide matrix: a broadcast spares the matrix its shuffle,
    which adaptive execution would find out only after both sides are shuffled.
    """
    rows = freeze(df)
    bound = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(rows) if rows.count() <= bound else rows
