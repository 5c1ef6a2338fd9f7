"""Vectors as .npy files: written in pieces, each a file of consecutive rows, and read by ranges of bytes.

A row has no name there but its place, counted over the files in their order. Files that other programs have written, one or many, are read alike.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.positions import by_number, running
from attestor.sources.shared import delete, opened, qualified, stored

#: Bytes of a file, of what a task reads, and of what is read at once.
FILE_BYTES, TASK_BYTES, RANGE_BYTES = 128 << 20, 128 << 20, 4 << 20
WRITTEN = "name string, first bigint, rows bigint, sha256 string"
HEADER = "file string, size bigint, offset bigint, descr string, rows bigint, width bigint, problem string"


class _Piece:
    """One file while it is written; it has its name once it is whole."""

    def __init__(self, files: fs.FileSystem, folder: str, number: int, first: int, rows: int, dimension: int):
        self.files, self.name, self.first, self.rows, self.left = files, f"part-{number:09d}.npy", first, rows, rows
        self.final, self.made = f"{folder}/{self.name}", f"{folder}/_{uuid.uuid4().hex}"
        self.out, self.digest = files.open_output_stream(self.made), hashlib.sha256()
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (rows, dimension)})
        self._put(head.getvalue())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)

    def add(self, positions: np.ndarray, values: np.ndarray) -> None:
        start = self.first + self.rows - self.left
        if len(positions) > self.left or not np.array_equal(positions, np.arange(start, start + len(positions))):
            raise ValueError("positions don't count from 0 without gaps")
        self._put(np.ascontiguousarray(values, "<f4").tobytes())
        self.left -= len(positions)

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        if self.left:
            raise ValueError("positions don't count from 0 without gaps")
        try:
            self.files.move(self.made, self.final)
        except OSError:
            if self.files.get_file_info(self.final).type != fs.FileType.File:
                raise
            self.files.delete_file(self.made)  # another attempt at this task has written the same bytes
        return self.name, self.first, self.rows, self.digest.hexdigest()


def write(vectors: DataFrame, folder: str, dimension: int, rows_per_file: int | None = None) -> DataFrame:
    """Writes (position, embedding) as files of float32 rows in place of what the folder holds; (name, first, rows, sha256) of each.

    Positions count from 0 without gaps, embeddings are of that dimension and hold no nulls; a ValueError says so otherwise.
    Without rows the folder is empty. Other columns are ignored.
    """
    spark, folder = vectors.sparkSession, qualified(vectors.sparkSession, folder)
    per = rows_per_file or max(1, FILE_BYTES // (4 * dimension))
    rows = vectors.select(F.col("position").cast("bigint").alias("position"), F.col("embedding").cast("array<float>").alias("embedding"))
    unfit = F.col("embedding").isNull() | (F.size("embedding") != dimension) | F.exists("embedding", F.isnull)
    n, low, high, bad = rows.agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.count_if(unfit)).first()
    if bad:
        raise ValueError(f"{bad} vectors aren't of dimension {dimension}")
    if n and (low, high) != (0, n - 1):
        raise ValueError("positions don't count from 0 without gaps")
    delete(spark, folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        piece, number, done = None, None, []
        for batch in batches:
            at, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(len(batch), dimension)
            cuts = [0, *(np.flatnonzero(np.diff(at // per)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if number != at[lo] // per:
                    if piece is not None:
                        done.append(piece.close())
                    number = int(at[lo] // per)
                    piece = _Piece(files, base, number, number * per, min(per, n - number * per), dimension)
                piece.add(at[lo:hi], flat[lo:hi])
        if piece is not None:
            done.append(piece.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["name", "first", "rows", "sha256"])

    spread = rows.withColumn("piece", F.floor(F.col("position") / per)).repartition(max(1, math.ceil(n / per)), "piece").sortWithinPartitions("position").drop("piece")
    return stored(spread.mapInArrow(run, WRITTEN), "npy")


def _head(files: fs.FileSystem, path: str, size: int) -> tuple[int, str | None, int, int, str | None]:
    """offset, type, rows and width of a file, or what is wrong with it."""
    try:
        with files.open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            if version not in ((1, 0), (2, 0)):
                raise ValueError(f"version {version} isn't read")
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            offset = f.tell()
        if kind.kind != "f" or len(shape) != 2 or by_column and min(shape) > 1:
            raise ValueError(f"no rows of floats: {kind.str}, {shape}{', by column' if by_column else ''}")
        if size != offset + shape[0] * shape[1] * kind.itemsize:
            raise ValueError(f"{size} bytes don't hold {shape[0]} rows of {shape[1]}")
        return offset, kind.str, *shape, None
    except ValueError as e:
        return 0, None, 0, 0, str(e)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """What each .npy file of a folder, or the one at a path, says of itself, and what is wrong with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((uri, size, *_head(*opened(uri), size)))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in HEADER.split(", ")])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "length")  # no contents are read
    return found.repartition("path").mapInArrow(run, HEADER)


def read(spark: SparkSession, path: str, dimension: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(position, embedding) of all rows, in float32. A file that can't be read, or whose width isn't dimension (or that of the others), is
    a ValueError. Files are cut into ranges of bytes, so one may be of any size; empty ones give no rows."""
    files = running(headers(spark, path), by_number(F.col("file")), "first", F.col("rows"))
    bad = files.filter("problem is not null").select("file", "problem").orderBy("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: {bad[0].problem}")
    size, least, most = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("width"), F.max("width")).first()
    if least != most or dimension is not None and most not in (None, dimension):
        raise ValueError(f"vectors of {least if least != dimension else most} values, not {dimension or least}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    where, at = opened(r["file"])
                    name, f = r["file"], where.open_input_file(at)
                kind, width = np.dtype(r["descr"]), r["width"]
                f.seek(r["offset"] + r["lo"] * width * kind.itemsize)
                data = f.read(r["n"] * width * kind.itemsize)
                values = np.frombuffer(data, kind).astype("<f4", copy=False)
                first = r["first"] + r["lo"]
                ends = np.arange(0, (r["n"] + 1) * width, width, dtype="int32") if width else np.zeros(r["n"] + 1, "int32")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + r["n"])), pa.ListArray.from_arrays(ends, pa.array(values))], ["position", "embedding"])
        if f is not None:
            f.close()

    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.greatest(F.lit(1), F.col("width") * 8))).cast("bigint")
    ranges = files.filter("rows > 0").withColumn("step", step).withColumn("lo", F.explode(F.expr("sequence(0L, rows - 1, step)")))
    ranges = ranges.select("file", "offset", "descr", "width", "first", "lo", F.least("step", F.col("rows") - F.col("lo")).alias("n"))
    spread = ranges.repartition(max(1, math.ceil(size / TASK_BYTES)), "file", "lo").sortWithinPartitions("file", "lo")
    return spread.mapInArrow(run, "position bigint, embedding array<float>")
