"""Benchmark decontamination: a BM25 index of the test items, searched with every passage by block-max WAND.

Passages are windows over whole texts, so long that each item lies within one. An item's score is its BM25 score divided
by what the item scores for itself, so one threshold fits all items. What is above it is verified by word shingles.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestor.llm.common import free_name, give_back, open_uri, qualified, release, scratch, small_batches, stored, text_or_empty

#: Items and bytes of one index; a larger benchmark is split, and the texts are searched with one index after another.
SHARD_ITEMS, SHARD_BYTES = 5_000, 2 << 20
#: Bytes of texts that are held to be searched with each of several indexes.
HELD_BYTES = 32 << 20
K1, B = 1.2, 0.75
#: Items of a block, of which the index keeps the largest weight of each term.
BLOCK = 8
#: Columns at most of the table in which the bound of a passage is looked up for all items, or groups of them, at once.
COLUMNS = 128
#: Share of its own score that an item needs, shingle length, and the shares of question and answer that have to be found.
RETRIEVE, SHINGLE, QUESTION, ANSWER = 0.6, 5, 0.8, 0.8
#: The last part of an item that counts as its answer.
ANSWER_PART = 1 / 3

words_of = re.compile(r"\w+").findall


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of size words; a shorter text is one shingle as a whole."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def overlaps(item: list[str], there: set[tuple[str, ...]], passage: list[str], size: int = SHINGLE) -> tuple[float, float]:
    """Shares of the shingles of an item's question, and of those that reach into its answer, that a passage holds."""
    if len(item) < size:
        own = tuple(item)
        found = float(any(tuple(passage[i : i + len(own)]) == own for i in range(len(passage) - len(own) + 1)))
        return found, found
    cut = max(1, math.ceil(len(item) * (1 - ANSWER_PART)))
    all_of = [tuple(item[i : i + size]) for i in range(len(item) - size + 1)]
    question = {s for i, s in enumerate(all_of) if i + size <= cut} or {all_of[0]}
    answer = {s for i, s in enumerate(all_of) if i + size > cut} or {all_of[-1]}
    return len(question & there) / len(question), len(answer & there) / len(answer)


@dataclass
class Index:
    """Postings of (item, weight) by term, items ascending; weights of an item sum to 1."""

    items: list
    words: list[list[str]]
    terms: dict[str, int]
    posts: list[list[tuple[int, float]]]
    top: np.ndarray
    blocks: list[dict[int, float]]
    bounds: np.ndarray
    longest: int


@dataclass
class Corpus:
    """What BM25 takes from all items with words: their number, mean length, and in how many of them each term occurs."""

    n: int
    mean: float
    seen: dict[str, int]


def corpus_of(lists: list[list[str]]) -> Corpus:
    lists = [words for words in lists if words]
    return Corpus(len(lists), sum(map(len, lists)) / max(1, len(lists)), Counter(w for words in lists for w in set(words)))


def build(rows: list[tuple], corpus: Corpus | None = None) -> Index:
    """From (item id, text); items without words can't be found and are left out. corpus is of all items if rows are a part."""
    rows = sorted(((i, words_of((t or "").lower())) for i, t in rows), key=lambda r: len(r[1]))
    rows = [r for r in rows if r[1]]
    counts = [Counter(words) for _, words in rows]
    corpus = corpus or corpus_of([words for _, words in rows])
    seen, mean = corpus.seen, corpus.mean
    terms = {w: k for k, w in enumerate(dict.fromkeys(w for own in counts for w in own))}
    posts: list[list[tuple[int, float]]] = [[] for _ in terms]
    for at, (own, (_, words)) in enumerate(zip(counts, rows, strict=True)):
        weight = {w: math.log(1 + (corpus.n - seen[w] + 0.5) / (seen[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in own.items()}
        total = sum(weight.values())
        for w, x in weight.items():
            posts[terms[w]].append((at, x / total))
    blocks = []
    for p in posts:
        most: dict[int, float] = {}
        for at, x in p:
            most[at // BLOCK] = max(most.get(at // BLOCK, 0.0), x)
        blocks.append(most)
    per = max(1, math.ceil(len(rows) / COLUMNS))
    bounds = np.zeros((len(posts), max(1, math.ceil(len(rows) / per))), np.float32)
    for k, p in enumerate(posts):
        for at, x in p:
            bounds[k, at // per] = max(bounds[k, at // per], x)
    top = np.array([max(x for _, x in p) for p in posts] + [0.0])  # the last: words that no item has
    return Index([i for i, _ in rows], [w for _, w in rows], terms, posts, top, blocks, bounds, max((len(w) for _, w in rows), default=0))


def wand(index: Index, query: list[int], least: float) -> list[tuple[int, float]]:
    """All items with a score of at least least, by document-at-a-time search with pivots and block maxima."""
    posts = [index.posts[t] for t in query]
    top = [float(index.top[t]) for t in query]
    blocks = [index.blocks[t] for t in query]
    at = [0] * len(query)
    live = sorted(range(len(query)), key=lambda k: posts[k][0][0])
    out = []
    while live:
        bound, pivot = 0.0, -1
        for n, k in enumerate(live):
            bound += top[k]
            if bound >= least:
                pivot = n
                break
        if pivot < 0:
            break
        doc = posts[live[pivot]][at[live[pivot]]][0]
        while pivot + 1 < len(live) and posts[live[pivot + 1]][at[live[pivot + 1]]][0] == doc:
            pivot += 1
        block = doc // BLOCK
        if sum(blocks[k].get(block, 0.0) for k in live[: pivot + 1]) < least:
            # No item before the block's end, or before the next list begins, can reach the threshold.
            goal = (block + 1) * BLOCK
            if pivot + 1 < len(live):
                goal = min(goal, posts[live[pivot + 1]][at[live[pivot + 1]]][0])
            goal = max(goal, doc + 1)
            moved = live[: pivot + 1]
        elif posts[live[0]][at[live[0]]][0] == doc:
            score = sum(posts[k][at[k]][1] for k in live[: pivot + 1])
            if score >= least:
                out.append((doc, score))
            goal, moved = doc + 1, live[: pivot + 1]
        else:
            goal, moved = doc, [k for k in live[: pivot + 1] if posts[k][at[k]][0] < doc]
        for k in moved:
            p, i = posts[k], at[k]
            while i < len(p) and p[i][0] < goal:
                i += 1
            at[k] = i
        live = sorted((k for k in live if at[k] < len(posts[k])), key=lambda k: posts[k][at[k]][0])
    return out


class Finder:
    """Searches texts with one index."""

    def __init__(self, index: Index, retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER):
        self.index, self.least, self.question, self.answer = index, retrieve - 1e-9, question, answer

    def windows(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Term ids, and the passages in which terms are heavy enough for any item: WAND without a pivot, for all at once."""
        none, n, size = len(self.index.terms), len(words), 2 * self.index.longest
        get = self.index.terms.get
        ids = np.fromiter([get(w, none) for w in words], np.int64, n)
        step = max(1, self.index.longest)
        starts = np.arange(0, max(1, n - step), step)
        heavy = np.append(0.0, np.cumsum(self.index.top[ids]))
        ends = np.minimum(starts + size, n)
        good = np.flatnonzero(heavy[ends] - heavy[starts] >= self.least)
        return ids, [(int(starts[i]), int(ends[i])) for i in good]

    def __call__(self, text: str) -> dict[int, tuple[float, float, float, int]]:
        """Verified items with score, question and answer overlap, and the passage's first word; of several passages the best."""
        words = words_of(text.lower())
        out: dict[int, tuple[float, float, float, int]] = {}
        if not words or not self.index.items:
            return out
        ids, passages = self.windows(words)
        none = len(self.index.terms)
        for a, b in passages:
            query = np.unique(ids[a:b])
            query = query[query < none]
            if not len(query) or self.index.bounds[query].sum(0).max() < self.least - 1e-4:
                continue
            found = wand(self.index, query.tolist(), self.least)
            if not found:
                continue
            there = shingles(words[a:b])
            for item, score in found:
                q, r = overlaps(self.index.words[item], there, words[a:b])
                if q >= self.question and r >= self.answer and (item not in out or (q + r, score) > (sum(out[item][1:3]), out[item][0])):
                    out[item] = (score, q, r, a)
        return out


def corpus_tables(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number and mean length of all items (id, text) with words, and the table (word, n) of the items that a word occurs in."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words_of(t.lower()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, lists), pa.int64()), pa.array([list(dict.fromkeys(x)) for x in lists], pa.list_(pa.string()))], ["size", "words"])

    lists = stored(items.select("text").mapInArrow(split, "size bigint, words array<string>").filter("size > 0"), "benchmark-words")
    n, mean = lists.agg(F.count(F.lit(1)), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    return n, mean, stored(lists.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "benchmark-terms")


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """One bounded index after another; weights are those of one index of all items."""
    items = benchmark.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, math.ceil(n / SHARD_ITEMS * 1.2) if n > SHARD_ITEMS else 1, math.ceil(size / SHARD_BYTES * 1.2) if size > SHARD_BYTES else 1)
    if shards == 1:
        yield build([(r.id, r.text) for r in items.collect()])
        return
    n_items, mean, table = corpus_tables(items)
    for k in range(shards):
        rows = [(r.id, r.text) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).collect()]
        # The counts of this part's terms only, so that the driver holds no more than the part asks for.
        own = items.sparkSession.createDataFrame(pd.DataFrame({"word": sorted({w for _, t in rows for w in words_of(t.lower())})}, dtype=object), "word string")
        yield build(rows, Corpus(n_items, mean, {r.word: r.n for r in table.join(own, "word").collect()}))


class Search:
    """Searches texts with all indexes in a worker: one that is broadcast, or files of the shared folder, loaded one after another."""

    def __init__(self, only: Broadcast | None, files: list[str]):
        self.files, self.only = files, Finder(only.value) if only else None

    def _finders(self) -> Iterator[Finder]:
        if self.only:
            yield self.only
        for uri in self.files:
            where, path = open_uri(uri)
            with where.open_input_file(path) as f:
                yield Finder(pickle.loads(f.readall()))

    def __call__(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (item, score, question and answer overlap, the passage's first word) of what is found in it."""
        out: list[list[tuple]] = [[] for _ in texts]
        for find in self._finders():
            for into, text in zip(out, texts, strict=True):
                into += [(find.index.items[at], *got) for at, got in sorted(find(text).items())]
        return out

    def held(self, batches: Iterator, size: Callable) -> Iterator[list]:
        """Batches in lists of about HELD_BYTES, so that files are loaded once for each list; one by one if there are none."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += size(batch)
            if not self.files or n >= HELD_BYTES:
                yield held
                held, n = [], 0
        if held:
            yield held


def searcher(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Callable[[], Search]:
    """Makes, in a worker, a search of the whole benchmark."""
    spark, only, files = benchmark.sparkSession, None, []
    found = indexes(benchmark, id_col, text_col)
    index = next(found)
    following = next(found, None)
    if following is None:
        only = spark.sparkContext.broadcast(index)  # SHARD_ITEMS and SHARD_BYTES at most
    else:
        folder = qualified(spark, scratch(spark, "indexes"))
        where, path = open_uri(folder)
        where.create_dir(path, recursive=True)
        for k, index in enumerate(itertools.chain([index, following], found)):
            with where.open_output_stream(f"{path}/{k:06d}.pickle") as f:
                f.write(pickle.dumps(index))
            files.append(f"{folder}/{k:06d}.pickle")
    return lambda: Search(only, files)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and item found in it: id, item, score, question_overlap, answer_overlap, at_word.

    Words are runs of letters, digits and underscores, lower-cased. A null text is an empty one and holds nothing; very long
    texts are searched whole; an empty benchmark finds nothing. Ids may repeat or be null; a repeated row is searched by
    itself. Items with the same text, or the same id, are each reported; of several passages that hold an item the best counts, the
    first of equals. Other columns are ignored. Nothing is shuffled, and the texts are read once: an index of SHARD_ITEMS and
    SHARD_BYTES at most is broadcast, more are stored and loaded one after another.
    """
    small_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    names, item_type = [id_col, item_col, "score", "question_overlap", "answer_overlap", "at_word"], to_arrow_type(kinds[1])
    make = searcher(benchmark, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        search = make()
        for held in search.held(batches, lambda b: b.nbytes):
            found = search([t for b in held for t in b.column(1).to_pylist()])
            ids = pa.concat_arrays([b.column(0) for b in held])
            take = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            cols = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * 5
            kinds = (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, score double, question_overlap double, answer_overlap double, at_word bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in whose text no item is found, with their columns as they were; no join, so ids don't matter."""
    small_batches(docs.sparkSession)
    make = searcher(benchmark, item_col, item_text)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        search = make()
        for held in search.held(batches, lambda s: int(s.str.len().sum())):
            found = iter(search([t for s in held for t in s]))
            for s in held:
                yield pd.Series([not next(found) for _ in range(len(s))], index=s.index, dtype=bool)
        search = held = found = None
        give_back()

    keep = free_name(docs, "keep")
    return docs.withColumn(keep, clean(text_or_empty(text_col))).filter(F.col(keep)).drop(keep)
