"""Session helpers: the shared folder and tables that cut lineage in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset and the master is local (tests), a temporary one is made; elsewhere that
    raises, as no executor would reach another's disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = getattr(spark, "_arclume_dir", None)
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = "file://" + tempfile.mkdtemp(prefix="arclume-")
            spark._arclume_dir = own
        at = own
    return at.rstrip("/")


def materialize(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over the files.

    Unlike ``checkpoint()`` the rows are computed once, stored by column and planned again with
    their true size. The files outlive executors and go with ``release`` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arclume-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    fs, hpath = _place(spark, path)
    fs.deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._arclume_path = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def release(*frames: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned and that no plan reads any more; other DataFrames are left alone."""
    for df in frames:
        if path := getattr(df, "_arclume_path", None):
            fs, hpath = _place(df.sparkSession, path)
            fs.delete(hpath, True)


class Rounds:
    """The rows that a loop has found, round by round, in few tables: from PARTS tables on, all but the largest are written as one (by ``fold``, if
    given). A table given to ``add`` may be read until the next call."""

    PARTS = 8

    def __init__(self, label: str, fold: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.label, self.fold = label, fold
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, df: DataFrame, rows: int) -> None:
        if len(self.parts) >= self.PARTS:
            self.parts.sort(key=lambda p: -p[0])
            small = [d for _, d in self.parts[1:]]
            whole = reduce(DataFrame.unionByName, small)
            merged = materialize(self.fold(whole) if self.fold else whole, self.label)
            self.parts[1:] = [(sum(n for n, _ in self.parts[1:]), merged)]
            release(*small)
        self.parts.append((rows, df))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [d for _, d in self.parts])


def operators(plan: object) -> set[str]:
    """Names of the operators of a JVM plan: the first word of each line of its tree."""
    return {m[1] for line in plan.toString().splitlines() if (m := re.match(r"[\s:+*()\d-]*([A-Za-z]\w*)", line))}


def reusable(df: DataFrame, label: str = "reused") -> DataFrame:
    """``df`` for a loop that reads it every round: written once if it is computed by joins, aggregates or sorts, as it is if it is a scan."""
    computed = {"Join", "Aggregate", "Distinct", "Deduplicate", "Window", "Sort", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Generate", "Expand", "MapInArrow", "MapInPandas"}
    return materialize(df, label) if operators(df._jdf.queryExecution().optimizedPlan()) & computed else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs far more than a shuffle, if it is a scan of fewer parts than cores.

    Large inputs have more parts than that and are left where they are.
    """
    if any(name.endswith("Exchange") for name in operators(df._jdf.queryExecution().executedPlan())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def default_tasks(spark: SparkSession, rows: int | None = None, rows_per_task: int = 1_000_000) -> int:
    """Tasks for a stage: two for each core, and more where the rows would not fit."""
    least = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-(rows or 0) // rows_per_task))
