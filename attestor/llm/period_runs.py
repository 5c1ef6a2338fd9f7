"""Stretches of words that repeat themselves with a period, found at every lag.

A text's words become numbers, and the array of numbers is compared with itself shifted by each lag up to n / min_exp. True
stretches of a comparison are runs of that period. A block of lags is one comparison of a matrix whose rows are the shifted
array, without a copy. Texts of up to WHOLE_BYTES are scanned by the task that reads them. Those of longer ones are cut into
ranges of LAGS lags, which Spark deals out over all machines; the runs of a text's ranges come together by its key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import small_batches, text_or_empty, trim

#: Bytes of a text that one task scans at all lags, the lags of a range of longer ones, and comparisons held at once.
WHOLE_BYTES, LAGS, BLOCK = 1 << 16, 2048, 1 << 20
_EIGHT = np.uint64(0x0101010101010101)
Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0 in the order of their first places."""
    known: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return ids.astype(np.uint16) if len(known) < 0xFFFE else ids


def scan(ids: np.ndarray, first: int, last: int, min_length: int, min_exp: int) -> list[Run]:
    """(start, length, period) of all longest stretches that keep a lag of first to last as period, min_length words and
    min_exp periods long or more. One whose smallest period is another lag is there as well if that lag isn't in the range."""
    n = len(ids)
    last = min(last, n // min_exp)
    if last < first or n < min_length:
        return []
    width, kind = -(-n // 8) * 8, ids.dtype
    top = np.iinfo(kind).max
    head, tail = np.full(width, top, kind), np.full(width + last + 1, top - 1, kind)  # no number equals what fills either up
    head[:n] = tail[:n] = ids
    # a true stretch is as long as its run without the first period; from 15 on it covers eight aligned places
    aligned = min(max(min_length - q, (min_exp - 1) * q) for q in range(1, min_length + 1)) >= 15
    found: dict[tuple[int, int], int] = {}
    rows = max(1, BLOCK // width)
    for low in range(first, last + 1, rows):
        lags = min(rows, last + 1 - low)
        shifted = np.ndarray((lags, width), kind, tail, low * kind.itemsize, (kind.itemsize, kind.itemsize))
        same = shifted == head
        hit = np.flatnonzero((same.view(np.uint64) == _EIGHT).any(axis=1) if aligned else same.any(axis=1))
        for part in np.array_split(hit, -(-len(hit) * width // BLOCK)) if len(hit) else ():
            flat = np.zeros((len(part), width + 1), np.int8)
            flat[:, :width] = same[part]
            step = np.diff(flat.ravel(), prepend=np.int8(0))
            opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            lag, length = low + part[opens // (width + 1)], closes - opens
            good = np.flatnonzero(length >= np.maximum(min_length - lag, (min_exp - 1) * lag))
            for start, size, q in zip((opens[good] % (width + 1)).tolist(), (length + lag)[good].tolist(), lag[good].tolist(), strict=True):
                found.setdefault((start, size), q)  # lags rise, so the smallest period stays
    return [(start, size, q) for (start, size), q in found.items()]


def merged(runs: list[Run]) -> list[Run]:
    """Runs of several ranges by start, then period; of one stretch with several periods the smallest, of which the others are multiples."""
    least: dict[tuple[int, int], int] = {}
    for start, size, q in runs:
        least[start, size] = min(q, least.get((start, size), q))
    return sorted(((start, size, q) for (start, size), q in least.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, exactly; of equals the one that starts first, then has the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, size, q in runs:
            edge[start + q] += 1
            edge[start + size] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _rows(ids: pa.Array, texts: list[tuple[list[bytes], list[Run]]], id_col: str) -> pa.RecordBatch:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
    columns = [
        ids,
        pa.array([len(w) for w, _ in texts], pa.int64()),
        pa.array([[named(r) for r in runs] for _, runs in texts], pa.list_(run)),
        pa.array([named(strongest(runs)) for _, runs in texts], run),
        pa.array([collapsed(w, runs) for w, runs in texts], pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "strongest", "collapsed"])


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exp: int = 3, whole_bytes: int = WHOLE_BYTES, lags: int = LAGS) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period, by start, then period), strongest (one of
    them or null), collapsed (the text's words without what repeats, joined by one space).

    Words part at \\x20 and \\x09-\\x0D and are numbered from 0. A run is a longest stretch of min_length words and min_exp times
    its smallest period or more; min_exp is 2 at least. Dropped is what a run holds beyond its first period; the strongest
    run has the greatest length / period, of equals the first, then that of the smallest period.

    A null text has no words. Ids may repeat or be null, and each row stands for itself. Texts are scanned whole, at all
    lags; those of more than whole_bytes in ranges of so many lags on many machines. Other columns are ignored; an
    empty table gives an empty result.
    """
    if min_exp < 2 or min_length < 1:
        raise ValueError("min_exp is 2 and min_length 1 at least")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, runs array<{_RUN}>, strongest {_RUN}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body in batch.column(1):
                words = body.as_py().split()
                texts.append((words, merged(scan(word_numbers(words), 1, len(words), min_length, min_exp))))
            yield _rows(batch.column(0), texts, id_col)
            batch = body = words = texts = None
            trim()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                ids = word_numbers(body.as_py().split()).astype(np.int32)
                for low in range(1, len(ids) // min_exp + 1, lags):
                    yield pa.RecordBatch.from_pylist([{"key": key.as_py(), "low": low, "ids": ids.tobytes()}], pa.schema([("key", pa.binary()), ("low", pa.int64()), ("ids", pa.binary())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, low, ids in zip(*batch.columns, strict=True):
                found = scan(np.frombuffer(ids.as_py(), np.int32), low.as_py(), low.as_py() + lags - 1, min_length, min_exp)
                start, size, q = np.array(found, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.binary()), *map(pa.array, (start, size, q))], ["key", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(body.as_py().split(), merged([(r["start"], r["length"], r["period"]) for r in runs.as_py() or ()])) for body, runs in zip(batch.column(1), batch.column(2), strict=True)]
            yield _rows(batch.column(0), texts, id_col)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    long = F.octet_length("text") > whole_bytes
    short = rows.filter(~long).select("id", F.col("text").cast("binary")).mapInArrow(whole, schema)
    # equal texts have the same runs, so each text is scanned once
    keyed = rows.filter(long).select(F.unhex(F.sha2("text", 256)).alias("key"), "id", F.col("text").cast("binary").alias("text"))
    dealt = keyed.dropDuplicates(["key"]).select("key", "text").mapInArrow(ranges, "key binary, low bigint, ids binary")
    runs = dealt.repartition("key", "low").mapInArrow(scanned, "key binary, start bigint, length bigint, period bigint")
    # at most the runs of one text, fewer than it has words
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionByName(keyed.join(runs, "key", "left").select("id", "text", "runs").mapInArrow(joined, schema))
