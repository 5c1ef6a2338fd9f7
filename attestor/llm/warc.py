"""WARC archives with revisit records, and a two-level index of captures.

Archives are gzip members, one a record. The index has a line for each capture, sorted by the URL's key (host reversed,
then the path) and the page's id, in gzip blocks. Each shard of it has a sparse directory beside it: the first line of each
block, and where the block lies. A lookup finds the shard, searches its directory and then the block by halves, and reads
the record's range from the archive. Reading all pages back is a lookup for each of them, sorted so that a task meets few shards.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import open_uri, qualified, small_batches

#: Lines of an index block, and bytes of html in the records of one archive, after which the next begins.
LINES, ARCHIVE_BYTES = 300, 256 << 20
#: Bytes of records that a task reads back at most, and lines of a shard of the index; in the mean, as ranges are sampled.
READ_BYTES, SHARD_LINES = 8 << 20, 100_000
#: Blocks that a reader keeps, and lookups that it resolves before it reads their records in the order of the archives.
KEPT_BLOCKS, LOOKUPS = 8, 2_000
#: Fixed value: the date of records, as the table has none.
DATE = "2000-01-01T00:00:00Z"

_PARTS = re.compile(r"(?s)^(.*?)://([^/?#]*)(.*)$")
CAPTURE = "key string, id bigint, archive string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: hosts that share an ending sort together. Without "://" the URL stands for itself."""
    found = _PARTS.match(url or "")
    if not found:
        return url or ""
    return ",".join(reversed(found[2].lower().split("."))) + ")" + (found[3] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri_of(url: str | None) -> str:
    """The URL as a header may hold it: what isn't ASCII, blanks and control characters as percent codes; "about:blank" without any."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"


def record(name: str, id_: int | None, url: str | None, payload: bytes, first: tuple[int | None, str | None] | None) -> bytes:
    """One WARC/1.1 record. first: id and URL of the page that a revisit repeats; it has no payload but names that one's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if first else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri_of(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {json.dumps(id_)}",
    ]
    if first:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {uri_of(first[1])}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {json.dumps(first[0])}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("a record is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def _finish(where: fs.FileSystem, made: str, final: str) -> None:
    """Puts a whole file in its place; of two attempts of one task either's file will do."""
    where.move(made, final)


class _Archive:
    """A file that grows under a name of its own attempt and appears under its final name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.where, base = open_uri(folder)
        self.final, self.name = f"{base}/{name}", name
        self.made = f"{base}/.{name}-{uuid.uuid4().hex}"
        self.where.create_dir(base, recursive=True)
        self.out, self.at = self.where.open_output_stream(self.made, compression=None), 0

    def add(self, data: bytes, level: int = 1) -> tuple[int, int]:
        packed = gzip.compress(data, level, mtime=0)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        self.out.close()
        _finish(self.where, self.made, self.final)


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, payload and, for revisits, id and url of the page that they repeat: of equal payloads the largest id is the response."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "size": F.octet_length("payload")})
    groups = rows.filter(F.col("size") >= least).groupBy("sha").agg(F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    joined = rows.join(groups, "sha", "left")
    return joined.select("id", "url", "payload", F.when(F.col("first.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")), F.col("first")).alias("first"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the records and returns the captures. The rows stay in their partitions; names come from these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, size, part = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None or size > ARCHIVE_BYTES:
                    if archive:
                        archive.close()
                    archive, n, size = _Archive(folder, f"part-{part:06d}-{n:04d}-{uuid.uuid4().hex}.warc.gz"), n + 1, 0
                size += len(payload)
                at, length = archive.add(record(f"{archive.name}/{archive.at}", id_, url, payload, first and (first["id"], first["url"])))
                for into, x in zip(out, (url_key(url), id_, archive.name, at, length), strict=True):
                    into.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "archive", "offset", "length"])
        if archive:
            archive.close()

    return rows.mapInArrow(run, CAPTURE)


#: A page's place in the index: its URL's key and its id, null before all.
Place = tuple[str, tuple[bool, int]]


def place_of(key: str, id_: int | None) -> Place:
    return key, (id_ is not None, id_ or 0)


@dataclass(frozen=True)
class Shard:
    """An entry of the list of shards: the first line's place, and the shard's name."""

    first: Place
    name: str


@dataclass(frozen=True)
class Block:
    """An entry of a shard's directory: the first line's place, and where the block lies."""

    first: Place
    offset: int
    length: int


def _directory(name: str) -> str:
    return name.removesuffix(".gz") + ".directory"


SHARD = "key string, id bigint, shard string"


def write_index(captures: DataFrame, folder: str, shards: int) -> DataFrame:
    """Sorts the captures by key and id into shards of compressed blocks, each with its directory; returns the list of shards: key, id, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lines, directory = None, [], []

        def flush() -> None:
            at, length = shard.add("".join(lines).encode(), 6)
            directory.append([*json.loads(lines[0])[:2], at, length])
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = shard or _Archive(folder, f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz")
                lines.append(json.dumps(row) + "\n")
                if len(lines) == LINES:
                    flush()
        if lines:
            flush()
        if shard:
            shard.close()
            beside = _Archive(folder, _directory(shard.name))
            beside.add("".join(json.dumps(x) + "\n" for x in directory).encode(), 6)
            beside.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]], pa.string()), pa.array([directory[0][1]], pa.int64()), pa.array([shard.name], pa.string())], ["key", "id", "shard"])

    ranged = captures.repartitionByRange(shards, "key", "id").sortWithinPartitions("key", "id")
    return ranged.mapInArrow(run, SHARD)


class Reader:
    """Ranges of the files of a folder; keeps the file opened last."""

    def __init__(self, folder: str):
        self.where, self.base = open_uri(folder)
        self.name, self.file = None, None

    def _file(self, name: str):
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.where.open_input_file(f"{self.base}/{name}")
        return self.file

    def read(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self._file(name).read_at(length, offset), 31)

    def whole(self, name: str) -> bytes:
        return zlib.decompress(self._file(name).readall(), 31)


class Captures:
    """Searches an index: the list of shards, a shard's directory and a block, each by halves."""

    def __init__(self, shards: list[Shard], folder: str):
        self.shards, self.reader = sorted(shards, key=lambda s: s.first), Reader(folder)
        self.directories: dict[str, list[Block]] = {}
        self.blocks: dict[tuple[str, int], list[list]] = {}

    def _blocks_of(self, shard: Shard) -> list[Block]:
        if shard.name not in self.directories:
            if len(self.directories) >= KEPT_BLOCKS:
                self.directories.clear()
            rows = map(json.loads, self.reader.whole(_directory(shard.name)).splitlines())
            self.directories[shard.name] = [Block(place_of(key, id_), offset, length) for key, id_, offset, length in rows]
        return self.directories[shard.name]

    def _lines(self, shard: Shard, block: Block) -> list[list]:
        at = shard.name, block.offset
        if at not in self.blocks:
            if len(self.blocks) >= KEPT_BLOCKS:
                self.blocks.clear()
            self.blocks[at] = [json.loads(x) for x in self.reader.read(shard.name, block.offset, block.length).splitlines()]
        return self.blocks[at]

    def between(self, low: Place, high: Place) -> Iterator[list]:
        """The captures from low to high: key, id, archive, offset, length."""
        n = max(0, bisect.bisect_left(self.shards, low, key=lambda s: s.first) - 1)
        while n < len(self.shards) and self.shards[n].first <= high:
            blocks = self._blocks_of(self.shards[n])
            k = max(0, bisect.bisect_left(blocks, low, key=lambda b: b.first) - 1)
            while k < len(blocks) and blocks[k].first <= high:
                lines = self._lines(self.shards[n], blocks[k])
                begin = bisect.bisect_left(lines, low, key=lambda r: place_of(*r[:2]))
                for row in lines[begin:]:
                    if place_of(*row[:2]) > high:
                        return
                    yield row
                k += 1
            n += 1


def lookup(url: str, captures: Captures, archives: Reader) -> list[tuple[dict[str, str], bytes]]:
    """All records of a URL, by the index and range reads."""
    key = url_key(url)
    return [parse(archives.read(*row[2:])) for row in captures.between((key, (False, 0)), (key, (True, 2**63)))]


def shards_of(index: DataFrame) -> list[Shard]:
    """The list of shards, SHARD_LINES captures each in the mean."""
    return [Shard(place_of(r.key, r.id), r.shard) for r in index.collect()]


def read_back(pages: DataFrame, shards: list[Shard], folder: str, tasks: int) -> DataFrame:
    """Looks up every page (distinct key and id): id, payload_bytes, payload_digest, record_type, refers_to of its captures.

    The figures of a response come from the payload that is read, those of a revisit from its headers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(shards)  # a name and a place for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures, archives = Captures(shared.value, folder), Reader(folder)
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(wanted), LOOKUPS):
                found = [row for key, id_ in wanted[lo : lo + LOOKUPS] for row in captures.between(place_of(key, id_), place_of(key, id_))]
                out: list[list] = [[], [], [], [], []]
                for row in sorted(found, key=lambda r: (r[2], r[3])):
                    headers, payload = parse(archives.read(*row[2:]))
                    kind, own = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != own:
                        raise ValueError("a payload doesn't fit its digest")
                    size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    refers = json.loads(headers["X-Refers-To-Page"]) if kind == "revisit" else None
                    for into, x in zip(out, (json.loads(headers["X-Page-ID"]), size, own, kind, refers), strict=True):
                        into.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = pages.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id")
    return spread.mapInArrow(run, "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes one record for each row of pages (id, url, html) and reads them back through the index: one row per input row.

    A null html is an empty payload, a null url an empty target. Of rows with equal payloads of at least least bytes the
    one with the largest id is the response and the others revisit it; rows that repeat that id are responses too. Null
    ids lose against all others; in a group of only null ids all are responses. Very long payloads are whole records; rows
    that repeat id and url are each found. An empty table writes nothing and gives an empty result; other columns are
    ignored. The folder has to be one that all executors share.
    """
    small_batches(spark)
    folder = qualified(spark, folder)
    write_archives(roles(pages, id_col, url_col, html_col, least), folder).write.parquet(folder + "/captures")
    captures = spark.read.schema(CAPTURE).parquet(folder + "/captures")
    n, size = captures.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    write_index(captures, folder, max(1, math.ceil(n / SHARD_LINES))).write.parquet(folder + "/shards")
    shards = shards_of(spark.read.schema(SHARD).parquet(folder + "/shards"))
    found = read_back(captures.select("key", "id").distinct(), shards, folder, max(1, math.ceil(size / READ_BYTES), math.ceil(n / SHARD_LINES)))
    return found.withColumnRenamed("id", id_col)
