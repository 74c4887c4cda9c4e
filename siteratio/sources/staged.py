"""Tables that are replaced as a whole: every write goes to a folder of its own.

``path``/run-... holds the rows of one write, ``path``/manifest one row per finished write. The row is appended
after the data, so a run that dies leaves the table as it was, a table may be replaced by what was computed from it,
and readers that began before go on with the folder they know. Old runs stay until they are removed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest"
_SCHEMA = "number long, folder string"


def _manifest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the last finished write; None where ``path`` is not such a table."""
    try:
        # no other Parquet folder is read this way, so a table of another kind can't be taken for one
        written = spark.read.schema(_SCHEMA).parquet(f"{path.rstrip('/')}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = written.selectExpr("max(struct(number, folder)) AS last").first().last
    return (last.number, last.folder) if last else None


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write ``df`` as the new content of the table at ``path``; returns the folder of its rows."""
    spark, root = df.sparkSession, path.rstrip("/")
    folder = f"run-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(f"{root}/{folder}")
    last = _manifest(spark, root)
    row = spark.createDataFrame([((last[0] if last else 0) + 1, folder)], _SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return f"{root}/{folder}"


def current(spark: SparkSession, path: str) -> str:
    """The folder to read for ``path``: that of its last finished write, or ``path`` itself if it was not published."""
    last = _manifest(spark, path)
    return f"{path.rstrip('/')}/{last[1]}" if last else path
