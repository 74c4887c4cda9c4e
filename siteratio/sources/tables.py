"""Reading wide matrices and writing result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteratio.functions.sqltext import ident, text
from siteratio.schema import ANALYTE, ROW_ID, SAMPLE, VALUE
from siteratio.sources.staged import current, publish

#: Missing values are written as this text in CSV files.
CSV_NULL = "NA"


def _read(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None, ids: Sequence[str]
) -> DataFrame:
    """A table, published or plain; in CSV the text NA is missing in measures, but a name may be written NA."""
    path = current(spark, path)
    if fmt != "csv":
        return (spark.read.schema(schema) if schema else spark.read).format(fmt).load(path)
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    measured = [f.name for f in df.schema if f.name not in ids and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.expr(f"nullif({ident(c)}, {text(CSV_NULL)})") for c in measured})


def read_wide(
    spark: SparkSession,
    path: str,
    analyte_col: str = ANALYTE,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    order_col: str = ROW_ID,
) -> DataFrame:
    """Raw matrix: ``row_id``, the analyte column and one column per sample.

    Row order decides which of several equal names counts as the first, so the table should
    carry an ordinal column. Without one, ``row_id`` orders the rows by file name, block of
    the file and place in it, for any number of files.
    CSV without a schema is read as text: measures are parsed when melted.
    """
    df = _read(spark, path, fmt, schema, [analyte_col, order_col])
    samples = [c for c in df.columns if c not in (order_col, analyte_col)]
    if order_col in df.columns:
        row = F.col(order_col).cast("bigint")
    else:
        row = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        )
    return df.select(row.alias(ROW_ID), F.col(ident(analyte_col)), *map(ident, samples))


def read_long(
    spark: SparkSession,
    path: str,
    analyte_col: str = ANALYTE,
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Raw counts in long form: analyte, sample and value, and ``row_id`` if the table has it.

    CSV without a schema is read as text: values are parsed by the job. NA is a missing value, but may be a name.
    """
    df = _read(spark, path, fmt, schema, [analyte_col, sample_col, ROW_ID])
    missing = [c for c in (analyte_col, sample_col, value_col) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing[0]}")
    row = [F.col(ROW_ID).cast("bigint").alias(ROW_ID)] if ROW_ID in df.columns else []
    return df.select(*row, *map(ident, [analyte_col, sample_col, value_col]))


def read_log2(
    spark: SparkSession,
    path: str,
    analyte_col: str = ANALYTE,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """The log2 ratio matrix: the analyte column and one column per site_time_subject."""
    df = _read(spark, path, fmt, schema, [analyte_col])
    if analyte_col not in df.columns:
        raise ValueError(f"{path} has no column {analyte_col}")
    return df.withColumnRenamed(analyte_col, ANALYTE)


def write_tables(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Write each table as one Parquet dataset below ``path``; returns name -> folder of its rows.

    ``path``/name is replaced as a whole (see ``staged``) and can be given to the readers as it is.
    """
    return {name: publish(df, f"{path.rstrip('/')}/{name}") for name, df in tables.items()}


def write_stat(df: DataFrame, path: str, name: str) -> str:
    """Write one statistics table as CSV with a header and NA for missing values."""
    return publish(df, f"{path.rstrip('/')}/{name}", "csv", header=True, nullValue=CSV_NULL)
