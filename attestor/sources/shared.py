"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own, but only if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = _own.setdefault("path", "file://" + tempfile.mkdtemp(prefix="attestor-store-"))
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there."""
    return f"{shared_dir(spark)}/attestor-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read back: it is computed once, and lost executors don't take it along. What this has given is given back as it is."""
    if getattr(df, "is_stored", False) is True:
        return df
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    if _passing.get() is not None:
        _passing.get().append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_stored = True
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within it are deleted at its end, and what it has shuffled is."""
    made: list[str] = []
    before = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(before)
        for path in made:
            delete(spark, path)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage. Until then Spark keeps the shuffle files of jobs that are done."""
    gc.collect()
    spark._jvm.System.gc()


def grown(df: DataFrame) -> DataFrame:
    """df, for a join of two tables that both grow with the input. Of such a table Spark knows the size of the columns that it was
    made of, not its own, and could send all of it through the driver; so both sides are shuffled, and too large partitions are split."""
    return df.hint("merge")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as executors need it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
