"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Changes when the files of a table do: their number and bytes, and when the table was last written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(path)
    return held.getFileCount(), held.getLength(), fs.getFileStatus(path).getModificationTime()


def distinct_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null ``key`` (repeated rows are equal), with the given columns only.

    The key's rows are first reduced inside each map task, so a key that holds a third of all
    rows arrives at its reducer as one row a task.
    """
    return df.select(key, *columns).where(df[key].isNotNull()).dropDuplicates([key])
