"""Shared folder, written intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}
_open: list[list[Workspace]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


class Workspace:
    """Tables that an operator writes to the shared folder, so that a lost executor costs no earlier stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Frees a table that no DataFrame in use reads any more."""
        fs, at = _fs(self.spark, self.path(name))
        fs.delete(at, True)

    def close(self) -> None:
        """Frees all tables, once no DataFrame in use reads any of them."""
        fs, at = _fs(self.spark, self.base)
        fs.delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Frees the tables of all workspaces opened inside; what is still wanted must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for work in _open.pop():
            work.close()


def ascii_lower(word: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where every character is one byte."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))
