"""Shared helpers: table access, shared scratch folders and the ASCII-only lower case."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Seconds between two collections of the driver's garbage.
TIDY = 4.0
#: Python workers and their JVM hold a batch or two at a time. Texts can be long, so batches end by bytes too.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, but only if all
    run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="attestor-shared-")
    return found


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, unless the session's owner has."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/attestor-{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def folders_made() -> list[str]:
    """The scratch folders that are still there, oldest first."""
    return list(_scratch)


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Deletes scratch folders whose tables nobody will read again."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scratch.remove(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark resolves it; a path without one isn't the executor's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def free_name(df: DataFrame, name: str) -> str:
    """name, with so many underscores behind it that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_tidied = [0.0]


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage, but not more often than every TIDY seconds. Until then the driver holds the plans and
    metrics of jobs that are done, and Spark keeps the shuffle files that only these still name."""
    if time.monotonic() - _tidied[0] > TIDY:
        gc.collect()
        spark._jvm.System.gc()
        _tidied[0] = time.monotonic()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """In a Python worker: what make() gives, kept for later tasks until another key is asked for or give_back() is called."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """At the start of a task: lets go of what an operator before this one has kept in the worker."""
    if _kept:
        give_back()


def give_back() -> None:
    """At the end of a task: hands a Python worker's memory back, as the worker lives on and others need it; also what was kept."""
    _kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Hands back what is free already, and keeps what is kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII strings take lower(), which is the same there and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))
