"""Intermediate tables in the cluster's shared checkpoint folder.

A stage that is read more than once is written as a parquet table instead of
being cached: the table survives lost executors, cuts the lineage, and its size
is known to the optimizer, so a broadcast join is chosen only when the table is
really small (``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files; else these stay until the driver happens to collect its garbage.

    For writes only: what reads its result lazily, or runs one DataFrame again, would have to make the files anew.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or the context's checkpoint dir.

    Only a local master without either setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gainsieve-"))
    return context.getCheckpointDir().rstrip("/")


class Workspace:
    """One folder of intermediate tables; every table name is written once."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.path = f"{root or shared_root(spark)}/gainsieve-{uuid.uuid4().hex}"
        self._written = 0
        self._tables: list[tuple[DataFrame, str]] = []

    def new_path(self, name: str) -> str:
        self._written += 1
        return f"{self.path}/{self._written:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((written, path))
        return written

    def step(self, df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
        """Write a table, then delete what only served to make it: its shuffle files and the tables done."""
        with releasing_shuffles(self.spark):
            written = self.table(df, name)
        self.drop(*done)
        return written

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, which nothing may read any more."""
        for df, path in self._tables:
            if any(df is t for t in tables):
                self._delete(path)
        self._tables = [(df, path) for df, path in self._tables if not any(df is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[df for df, _ in self._tables if not any(df is t for t in tables)])

    def counted(self, df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
        """Write a table and read aggregates (aliased columns) off it.

        Not an Observation: once a session has one, Spark 4.1 cannot ship a fitted
        logistic regression to executors, because its summary holds the session.
        """
        written = self.table(df, name)
        return written, written.agg(*metrics).first().asDict()

    def close(self) -> None:
        """Delete the folder and all its tables, which nothing may read any more."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()
