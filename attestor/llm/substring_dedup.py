"""Repeated passages by FM-indexes.

A window of WINDOW words has an anchor: the least hash of the runs of ANCHOR words in it. Equal windows have equal anchors,
so texts are cut into segments, the windows in a row that share an anchor, and a shard has all segments of its anchors.
Segments of one anchor with the same words (by a keyed hash of 96 bits) are one entry; the first stands for all, and the
others repeat it from end to end. Where an anchor has several entries, or stands in one more than once, they are indexed in shards of bounded size: suffixes
are sorted, and the Burrows-Wheeler transform goes into a wavelet matrix of bit vectors, which takes some 2.6 bytes a word
with its counts. The entries are then streamed through the index. Backward search gives at each place how far the words
before it match; it stops where only the place itself is left and passes over all windows that hold what stopped it. Runs
of windows that an earlier place has too are reported as intervals.

Anchors that much of the corpus shares, by a sample or because their entries overfill a shard, aren't indexed. Their
entries fall apart into windows, and these are grouped by keyed hashes of 128 bits, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import release, small_batches, stored, text_or_empty
from attestor.llm.words import Words, mixed, new_keys

WINDOW, ANCHOR = 20, 5
#: Words of the segments that one index holds, and windows of a segment at most.
SHARD_WORDS, RUN = 400_000, 64
#: Words that are cut at once.
BLOCK = 1 << 18
#: Texts sampled to find common anchors, the hits in the sample that make an anchor common, and how many of them are
#: noted at most. The sample decides only how rows are spread and which way they take; results don't depend on it. It is
#: larger where an anchor with MOST segments would be missed.
SAMPLE, HITS, COMMON, MOST = 4_000, 40, 100_000, 1_000_000
#: Parts into which the segments of a common anchor with the same words are split.
SALTS = 64


class Cutter:
    """Segments of texts whose words are given by their hashes."""

    def __init__(self, keys: tuple[int, ...], window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor, self.grams, self.ends = window, anchor, keys[4 : 4 + anchor], keys[4 + anchor : 8 + anchor]
        self.powers = []
        for base in keys[8 + anchor : 10 + anchor]:
            up, down = (np.full(BLOCK + window + 1, np.uint64(x)) for x in (base, pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            self.powers.append((np.cumprod(up), np.cumprod(down)))

    @staticmethod
    def n_keys(anchor: int = ANCHOR) -> int:
        return 10 + anchor

    def _sums(self, h: np.ndarray, k: int) -> np.ndarray:
        return np.append(np.uint64(0), np.cumsum(h * self.powers[k][0][: len(h)]))

    def prints(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each run of words [start, stop), wherever it stands."""
        out = []
        for k, own in enumerate((h, mixed(h, self.ends[0], 29))):
            sums = self._sums(own, k)
            out.append(mixed((sums[stop] - sums[start]) * self.powers[k][1][start] + (stop - start).astype(np.uint64), self.ends[1]))
        return out[0], out[1]

    def _block(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(h) - self.window + 1
        edge = np.zeros(n + 1, np.int8)
        has = np.diff(first) >= self.window
        edge[first[:-1][has]] += 1
        edge[first[1:][has] - self.window + 1] -= 1
        live = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        m = len(h) - self.anchor + 1
        low = np.zeros(m, np.uint64)
        for i, key in enumerate(self.grams):
            low += h[i : m + i] * np.uint64(key)
        low = grams = mixed(mixed(low, self.ends[2]), self.ends[3])
        width, size = self.window - self.anchor + 1, 1
        while size * 2 <= width:  # the least value of each window, by doubling and then by two overlapping parts
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        low = np.minimum(low[:n], low[width - size : width - size + n])
        same = live[1:] & live[:-1] & (low[1:] == low[:-1])
        opens, closes = live.copy(), live.copy()
        opens[1:] &= ~same
        closes[:-1] &= ~same
        start = np.flatnonzero(opens)
        count = np.flatnonzero(closes) + 1 - start
        if len(count) and count.max() > RUN:
            parts = -(-count // RUN)
            of = np.repeat(np.arange(len(count)), parts)
            off = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
            start, count = start[of] + off, np.minimum(count[of] - off, RUN)
        s1, s2 = self.prints(h, start, start + count + self.window - 1)
        text = np.searchsorted(first, start, "right") - 1
        span = count + width - 1  # the places of anchors in a segment's windows; if the anchor stands at two of them, windows may repeat within it
        held = grams[_spans(start, span)] == np.repeat(low[start], span)
        twice = np.add.reduceat(held, np.cumsum(span) - span, dtype=np.int32) > 1 if len(start) else np.zeros(0, bool)
        return text, start - first[text], count, low[start].view(np.int64), s1.view(np.int64), (s2 >> np.uint64(32)).astype(np.uint32).view(np.int32), twice

    def __call__(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, first window, windows, anchor, the two hashes of the words, whether the anchor stands in it more than once) of each segment."""
        if len(h) <= BLOCK + self.window:
            if len(h) >= self.window:
                yield self._block(h, first)
            return
        for i in range(len(first) - 1):  # texts by themselves, long ones in blocks
            own = h[first[i] : first[i + 1]]
            for at in range(0, len(own) - self.window + 1, BLOCK):
                part = own[at : at + BLOCK + self.window - 1]
                text, begin, *rest = self._block(part, np.array([0, len(part)]))
                yield text + i, begin + at, *rest


class BitRank:
    """A bit vector with counts by 64 bits; rank(i) is the number of ones before i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), "<u8"), np.uint64(0))
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """Backward search over a text of small integers, for patterns of up to depth symbols; order is the suffix array."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW):
        n, top = len(text), int(text.max(initial=0))
        self.n, self.levels = n, max(1, top.bit_length())
        # Suffixes by their first depth symbols, equal ones by their places: by as many symbols as fit a key, then by doubling.
        size = max(1, 62 // self.levels)
        rank = text.astype(np.int64)
        for i in range(1, min(size, depth)):
            rank = (rank << self.levels) | np.append(text[i:], np.zeros(min(i, n), text.dtype))[:n]
        while True:
            self.order = np.argsort(rank, kind="stable")
            own = rank[self.order]
            new = np.append(np.zeros(min(n, 1), np.int64), np.cumsum(own[1:] != own[:-1]))
            if size >= depth or not n or new[-1] == n - 1:
                break
            rank[self.order] = new
            rank = rank * (int(new[-1]) + 2) + np.append(rank[size:] + 1, np.zeros(min(size, n), np.int64))[:n]
            size *= 2
        bwt = text[self.order - 1].astype(np.int64)
        self.starts = np.searchsorted(np.sort(text), np.arange(top + 2))
        self.bits, self.zeros = [], []
        symbols = np.arange(top + 1)
        self.begins = np.zeros(top + 1, np.int64)  # where a symbol's range begins below the last level
        for level in range(self.levels - 1, -1, -1):
            ones = ((bwt >> level) & 1).astype(bool)
            bits, zeros = BitRank(ones), int(n - ones.sum())
            self.bits.append(bits)
            self.zeros.append(zeros)
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
            self.begins = self._down(len(self.bits) - 1, ((symbols >> level) & 1).astype(bool), self.begins)

    def _down(self, k: int, one: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self.bits[k].rank(at)
        return np.where(one, self.zeros[k] + ones, at - ones)

    def back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search for each end of an interval: how many suffixes lie before those that the symbol goes before."""
        begin = self.starts[symbols] - self.begins[symbols]
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = self._down(k, ((symbols >> level) & 1).astype(bool), at)
        return begin + at

    def match(self, text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the text's own runs of depth symbols at the given places, from their ends: (interval's ends, symbols before
        those that single the place out, or -1 if all of them together don't)."""
        low, high, left = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.full(len(at), -1)
        live = np.arange(len(at))
        for k in range(depth - 1, -1, -1):
            c = text[at[live] + k]
            ends = self.back(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = ends[: len(live)], ends[len(live) :]
            alone = high[live] - low[live] == 1
            left[live[alone]] = k
            live = live[~alone]
            if not len(live):
                break
        return low, high, left


def repeats(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of the runs of windows that an earlier segment, or an earlier place in it, has too.

    Segments come in the order of their places; words are all their words, and bounds where each begins, with one more
    for the end.
    """
    sizes = np.diff(bounds)
    _, flat = np.unique(words, return_inverse=True)
    text = np.zeros(len(flat) + len(sizes), np.int32)  # 0 ends a segment
    text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat + 1
    index = FMIndex(text, window)
    order = np.append(index.order, len(text))
    begins = bounds[:-1] + np.arange(len(sizes))
    live = np.flatnonzero(sizes >= window)
    at, last = begins.copy(), begins + sizes - window
    out = []
    while len(live):
        place = at[live]
        low, high, left = index.match(text, place, window)
        at[live] = place + left + 1  # windows that hold what singles a place out stand there only
        full = left < 0
        if full.any():
            begin, one, which = np.unique(low[full], return_index=True, return_inverse=True)
            earliest = np.minimum.reduceat(order, np.stack([begin, high[full][one]], 1).ravel())[::2][which]
            own, seg = place[full], live[full]
            again = earliest < own
            # From a repeat on both places are read side by side; as long as they agree, the windows that end there are repeats too.
            run = again.astype(np.int64)
            go = np.flatnonzero(again)
            while len(go):
                next_own, next_first = own[go] + run[go] + window - 1, earliest[go] + run[go] + window - 1
                go = go[(text[next_own] != 0) & (text[next_own] == text[next_first])]
                run[go] += 1
            at[seg] = own + np.maximum(run, 1)
            out.append((seg[again], (own - begins[seg])[again], run[again]))
        live = live[at[live] <= last[live]]
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def covered(n_words: int, starts: np.ndarray, windows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words that any of the windows covers."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + windows - 1 + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks), and kept_text if asked.

    Places are ordered by id (null before all), then by a hash of the text where rows share an id, then by word. A null
    text has no words. Rows that repeat id and text share one fate. Texts shorter than a window keep all words; very long
    ones are cut in blocks, as a whole. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = new_keys(Cutter.n_keys())
    segments = _segments(keyed, kind, keys, window)
    marked = stored(_marked(segments, window), "segments")
    # Of a common anchor's segments with the same words each part had a first; the first of these stands for all.
    salted = marked.filter("way = 'salted'").withColumn("place", F.rank().over(Window.partitionBy("s1", "s2").orderBy("id", "h", "at")))
    salted = stored(salted, "salted")
    whole = marked.filter("way = 'whole'").select("id", "h", "at", "n").union(salted.filter("place > 1").select("id", "h", "at", "n"))
    apart = marked.filter("way = 'windows'").select("id", "h", "at", "n").union(salted.filter("place = 1").select("id", "h", "at", "n"))
    found = [whole, _indexed(keyed, marked.filter("way = 'index'").select("id", "h", "k", "at", "n"), kind, keys, window)]
    if not apart.isEmpty():
        found.append(_apart(keyed, apart, kind, keys, window))
    gone = found[0]
    for more in found[1:]:
        gone = gone.unionByName(more)
    gone = stored(gone.groupBy("id", "h").agg(F.collect_set(F.struct("at", "n")).alias("gone")), "intervals")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            total, removed, sha, texts = [], [], [], []
            for text, off in zip(batch.column(1), batch.column(2), strict=True):
                words = kept = text.as_py().encode().split()
                if off.is_valid:
                    runs = off.values
                    gone = covered(len(words), runs.field("at").to_numpy(), runs.field("n").to_numpy().astype(np.int64), window)
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                data = b" ".join(kept)
                sha.append(hashlib.sha256(data).hexdigest())
                if with_text:
                    texts.append(data.decode())
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    both = keyed.join(gone, keyed["id"].eqNullSafe(gone["id"]) & (keyed["h"] == gone["h"]), "left").select(keyed["id"], "text", "gone")
    return both.mapInArrow(finish, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def _segments(keyed: DataFrame, kind: str, keys: tuple[int, ...], window: int) -> DataFrame:
    """id, h, a, s1, s2, at, n, twice, common: the segments of all texts, whether their anchor stands in them more than once, and whether it is common."""

    def cut(common: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            words, cutter = Words(keys), Cutter(keys, window)
            for batch in batches:
                for begin, h, first in words(batch.column(2)):
                    for text, at, n, a, s1, s2, twice in cutter(h, first):
                        take = pa.array(text + begin)
                        cols = [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, (a, s1, s2, at.astype(np.int32), n.astype(np.int32), twice, np.isin(a, common)))]
                        yield pa.RecordBatch.from_arrays(cols, ["id", "h", "a", "s1", "s2", "at", "n", "twice", "common"])

        return run

    schema = f"id {kind}, h bigint, a bigint, s1 bigint, s2 int, at int, n int, twice boolean, common boolean"
    texts = keyed.select("id", "h", "text")
    n = texts.count()
    share = max(SAMPLE / max(n, 1), HITS / MOST)
    sample = texts if share >= 1 else texts.sample(share, seed=11)
    hits = sample.mapInArrow(cut(np.zeros(0, np.int64)), schema).groupBy("a").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= HITS)
    common = hits.orderBy(F.desc("hits"), "a").limit(COMMON).select("a").toArrow().column(0).to_numpy()
    return texts.mapInArrow(cut(np.sort(common)), schema)


def _marked(segments: DataFrame, window: int) -> DataFrame:
    """id, h, k, at, n, way, s1, s2 of the segments that repeat others or may hold repeats.

    Rows go by anchor; those of common anchors by their words and a salt instead, as many texts have the same.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    spread = segments.withColumn("k", F.when(F.col("common"), F.xxhash64("a", "s1", "s2", salt)).otherwise(F.col("a"))).repartition("k")
    entry = Window.partitionBy("k", "s1", "s2").orderBy("id", "h", "at")
    ranked = spread.withColumns({"place": F.rank().over(entry), "row": F.row_number().over(entry)})
    once: Column = F.col("row") == 1
    anchor = Window.partitionBy("k")
    ranked = ranked.withColumns({"entries": F.count(F.when(once, 1)).over(anchor), "words": F.sum(F.when(once, F.col("n") + (window - 1))).over(anchor)})
    way = F.when(F.col("place") > 1, "whole").when(F.col("common"), "salted").when((F.col("entries") == 1) & ~F.col("twice"), None).when(F.col("words") > SHARD_WORDS, "windows").otherwise("index")
    return ranked.select("id", "h", "k", "at", "n", way.alias("way"), F.when(F.col("common"), F.col("s1")).alias("s1"), F.when(F.col("common"), F.col("s2")).alias("s2")).filter("way is not null")


def _sought(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h, text, want: the texts that have wanted segments, with these."""
    wanted = wanted.distinct()
    per_doc = wanted.groupBy("id", "h").agg(F.collect_list(F.struct(*(c for c in wanted.columns if c not in ("id", "h")))).alias("want"))
    return keyed.join(per_doc, keyed["id"].eqNullSafe(per_doc["id"]) & (keyed["h"] == per_doc["h"])).select(keyed["id"], keyed["h"], "text", "want")


def _places(batch: pa.RecordBatch, begin: int, first: np.ndarray) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
    """Of the texts from begin on, whose words begin at first: row and wanted segment, and where it begins among the words."""
    want = batch.column(3).slice(begin, len(first) - 1)
    rows = np.repeat(np.arange(len(first) - 1), np.asarray(want.value_lengths()))
    flat = want.flatten()
    return rows, flat, first[rows] + flat.field("at").to_numpy()


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at start."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _indexed(keyed: DataFrame, wanted: DataFrame, kind: str, keys: tuple[int, ...], window: int) -> DataFrame:
    """id, h, at, n: intervals of repeated windows in the segments of anchors that have several entries."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = Words(keys)
        for batch in batches:
            for begin, h, first in words(batch.column(2)):
                rows, want, start = _places(batch, begin, first)
                size = want.field("n").to_numpy().astype(np.int64) + window - 1
                own = h[_spans(start, size)]
                ends = np.append(0, np.cumsum(8 * size)).astype(np.int32)
                take = pa.array(rows + begin)
                held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), want.field("k"), want.field("at"), held], ["id", "h", "k", "at", "own"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            k, h, at = (rows.column(c).to_numpy() for c in ("k", "h", "at"))
            once = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (at[1:] != at[:-1]))
            if not once.all():  # rows that repeat id and text
                rows = rows.take(pa.array(np.flatnonzero(once))).combine_chunks()
            _, ends, data = rows.column("own").chunk(0).buffers()
            own = rows.column("own").chunk(0)
            bounds = np.frombuffer(ends, np.int32, len(own) + 1, own.offset * 4).astype(np.int64) // 8
            found, begin, n = repeats(np.frombuffer(data, np.uint64)[bounds[0] : bounds[-1]], bounds - bounds[0], window)
            take = pa.array(found)
            first = rows.column("at").take(take).to_numpy() + begin
            cols = [rows.column("id").take(take).combine_chunks(), rows.column("h").take(take).combine_chunks(), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], ["id", "h", "at", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(2).to_numpy()
            before = np.append(0, np.cumsum(np.asarray(pc.binary_length(batch.column(4))).astype(np.int64) // 8))
            begin = 0
            for b in np.flatnonzero(np.append(last is None or k[0] != last, k[1:] != k[:-1])).tolist():
                if size + before[b] - before[begin] > SHARD_WORDS:
                    held.append(batch.slice(begin, b - begin))
                    yield flush()
                    held.clear()
                    size, begin = 0, b
            held.append(batch.slice(begin))
            size, last = size + int(before[-1] - before[begin]), k[-1]
        if held:
            yield flush()

    cuts = _sought(keyed, wanted).mapInArrow(slices, f"id {kind}, h bigint, k bigint, at int, own binary")
    # Windows of two anchors never match, so only the order within an anchor counts.
    shards = cuts.repartition("k").sortWithinPartitions("k", "id", "h", "at")
    return shards.mapInArrow(index, f"id {kind}, h bigint, at int, n int")


def _apart(keyed: DataFrame, wanted: DataFrame, kind: str, keys: tuple[int, ...], window: int) -> DataFrame:
    """id, h, at, n (1): the windows of the wanted segments that an earlier place among them has too."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words, cutter = Words(keys), Cutter(keys, window)
        for batch in batches:
            for begin, h, first in words(batch.column(2)):
                rows, want, start = _places(batch, begin, first)
                n = want.field("n").to_numpy().astype(np.int64)
                of, offset = np.repeat(np.arange(len(n)), n), _spans(np.zeros(len(n), np.int64), n)
                at = start[of] + offset
                for lo in range(0, len(at), BLOCK // window):
                    part = slice(lo, lo + BLOCK // window)
                    own = h[(at[part, None] + np.arange(window)).ravel()]
                    begins = np.arange(0, len(own), window)
                    w1, w2 = cutter.prints(own, begins, begins + window)
                    take = pa.array(rows[of[part]] + begin)
                    place = want.field("at").to_numpy()[of[part]] + offset[part]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["id", "h", "at", "w1", "w2"])

    each = stored(_sought(keyed, wanted).mapInArrow(single, f"id {kind}, h bigint, at int, w1 bigint, w2 bigint"), "windows")
    place = F.struct("id", "h", "at")
    first = each.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("w1", "w2", "first")
    both = each.join(stored(first, "first-windows"), ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    return both.select("id", "h", "at", F.lit(1).alias("n"))
