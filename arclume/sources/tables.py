"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas by path, time of change and length, so that a table's footers are read once.
_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    path = f"{directory}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def tables(spark: SparkSession, directory: str, *names: str) -> list[DataFrame]:
    return [table(spark, directory, n) for n in names]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
