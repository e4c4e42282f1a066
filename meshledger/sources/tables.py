"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meshledger.functions.timebins import day


_CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] | str | None = None
) -> None:
    """Replace the table at ``path`` with snappy Parquet."""
    if not hasattr(df, "write"):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)


def write_by_day(flows: DataFrame, path: str, ts: str = "start_ts") -> None:
    """One folder per local day, rows sorted by time inside a file.

    Ranges of day and time follow the data, so a busy day is cut into as many files as it needs.
    """
    (
        flows.withColumn("day", day(ts))
        .repartitionByRange("day", ts)
        .sortWithinPartitions("day", ts)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy("day")
        .parquet(path)
    )


def consolidate(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_archives(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Every archive of a list of folders as one table."""
    return spark.read.schema(schema).parquet(*paths)


def write_csv(df: DataFrame, path: str) -> None:
    """Write with a header; timestamps keep their microseconds."""
    df.write.mode("overwrite").options(header=True, timestampNTZFormat=_CSV_TIME).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).options(header=True, timestampNTZFormat=_CSV_TIME).csv(path)
    return df.select(*columns) if columns else df
