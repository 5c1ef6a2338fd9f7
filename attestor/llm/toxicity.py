"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters within words, one of toxic and one of ordinary texts, differ in their highest order only. Below
it both back off to one distribution made of the pooled continuation counts, so an expression that neither class has
shown counts for neither, and a rare one leans on its parts. A text's log-odds are its log-likelihood ratio divided by its
length in words, plus a logistic curve over what its words' ratios exceed a baseline of the corpus by, beyond a margin,
also by length. The baseline and the margin are the same for all texts, so a text that is toxic throughout shows it. The
curve is fitted on texts that the scoring model hasn't seen.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import free_name, give_back, release, small_batches, text_or_empty

#: The model is fitted on at most so many labelled texts of each class, those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = 1_500
#: Letters of a gram, its discount, and the part of a long word that is looked at (the rest follows as a word of its own).
ORDER, DISCOUNT, WORD = 7, 0.95, 40
#: Nats above the baseline at which a word begins to count in the excess, and the share of ordinary words below the baseline.
MARGIN, BASELINE = 3.0, 0.95
#: Words whose ratio a worker remembers before it starts anew.
MAX_WORDS = 150_000
THRESHOLD = 0.7

_FIND = re.compile(rf"[^\W\d_]{{1,{WORD}}}").findall


def words_of(text: str) -> list[str]:
    return _FIND(text.lower())


@dataclass
class Ratios:
    """log P(letter | context, toxic) - log P(letter | context, ordinary): by gram, else by its context, else 0."""

    grams: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    order: int = ORDER
    baseline: float = 0.0  # of the ordinary texts' words, a share of BASELINE has at most this ratio

    def word(self, word: str) -> float:
        text, total, span = "^" + word + "$", 0.0, self.order
        for i in range(1, len(text)):
            gram = text[max(0, i + 1 - span) : i + 1]
            got = self.grams.get(gram)
            total += self.contexts.get(gram[:-1], 0.0) if got is None else got
        return total


class KneserNey:
    """Of two classes: P(letter | up to order - 1 letters before it), from (word, times in ordinary texts, times in toxic texts).

    The highest order is a class's own, with absolute discounting; below it both back off to one distribution of
    continuation counts, the number of distinct letters before a gram, pooled over the classes. The last resort gives all
    letters, and one that was never seen, the same share.
    """

    def __init__(self, counts: Iterable[tuple[str, int, int]], order: int = ORDER, discount: float = DISCOUNT):
        self.discount, self.by_class = discount, (Counter(), Counter())
        for word, *times in counts:
            text = "^" + word + "$"
            grams = [text[max(0, i + 1 - order) : i + 1] for i in range(1, len(text))]
            for c, n in zip(self.by_class, times, strict=True):
                if n:
                    for g in grams:
                        c[g] += n
        self.seen = set(self.by_class[0]) | set(self.by_class[1])
        self.shared: dict[str, int] = Counter()
        level = self.seen
        while level:
            below = {(g, g[1:]) for g in level if len(g) > 1}
            self.shared.update(tail for _, tail in below)
            level = {tail for _, tail in below}
        self.total, self.kinds = self._by_context(self.shared)
        self.sums, self.types = zip(*map(self._by_context, self.by_class), strict=True)
        self.letters = max(1, len({g[-1] for g in self.seen}))
        self.memo: dict[str, float] = {}

    @staticmethod
    def _by_context(counts: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
        """Sum of counts and number of grams by context."""
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return dict(total), dict(kinds)

    def backoff(self, g: str) -> float:
        """P(last letter | the rest) of the shared distribution."""
        if (known := self.memo.get(g)) is None:
            h, d = g[:-1], self.discount
            lower = self.backoff(g[1:]) if h else 1.0 / (self.letters + 1)
            known = (max(self.shared.get(g, 0) - d, 0.0) + d * self.kinds[h] * lower) / self.total[h] if self.total.get(h) else lower
            self.memo[g] = known
        return known

    def probability(self, k: int, g: str) -> float:
        """P(last letter | the rest) of class k (0: ordinary, 1: toxic)."""
        h, low, d = g[:-1], self.backoff(g[1:] if len(g) > 1 else g), self.discount
        if h not in self.sums[k]:
            return low
        return (max(self.by_class[k].get(g, 0) - d, 0.0) + d * self.types[k][h] * low) / self.sums[k][h]

    def weight(self, k: int, h: str) -> float:
        """The share of the back-off after context h."""
        return self.discount * self.types[k][h] / self.sums[k][h] if h in self.sums[k] else 1.0


def fit_ratios(counts: Iterable[tuple[str, int, int]], order: int = ORDER, discount: float = DISCOUNT) -> Ratios:
    """From (word, times in ordinary texts, times in toxic texts)."""
    counts = list(counts)
    model = KneserNey(counts, order, discount)
    ratio = lambda of, x: math.log(of(1, x) / of(0, x))
    out = Ratios({g: ratio(model.probability, g) for g in model.seen}, {h: ratio(model.weight, h) for h in model.sums[0].keys() | model.sums[1].keys()}, order)
    usual = sorted((out.word(w), n) for w, n, _ in counts if n)
    if usual:
        upto = np.cumsum([n for _, n in usual])
        out.baseline = usual[int(np.searchsorted(upto, BASELINE * upto[-1]))][0]
    return out


class Scorer:
    """The figures of a text: its ratio by length, and its words' excess by length on a log scale. Without words there is neither."""

    def __init__(self, ratios: Ratios):
        self.ratios, self.known = ratios, {}

    def __call__(self, text: str) -> tuple[float, float]:
        words = words_of(text)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known, of = self.known, self.ratios.word
        got = [known[w] if w in known else known.setdefault(w, of(w)) for w in words]
        if not got:
            return 0.0, math.log(1e-3)
        x = np.array(got)
        return float(x.mean()), math.log(1e-3 + float(np.maximum(x - self.ratios.baseline - MARGIN, 0.0).mean()))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray) -> tuple[float, float]:
    """Slope and intercept beside a given offset, by Newton's method with a slight pull to 0; classes weigh as in the whole labelled table."""
    a, scale = np.zeros(2), max(1e-9, float(np.std(x)) if len(x) else 1.0)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a + offset, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-3 * a
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, a[0]) / scale), float(a[1])


@dataclass
class Toxicity:
    ratios: bytes  # pickled Ratios, which only workers unpack
    slope: float
    intercept: float

    def probability(self, ratio: np.ndarray, excess: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(ratio + self.slope * excess + self.intercept, -30, 30)))


def held_out(id_col: str):
    """crc32 of the id's text modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS) -> Toxicity:
    """Learns from labelled texts that aren't held out, a bounded sample of each class.

    Rows with null ids or labels, and ids that carry both labels, are left out; of several texts of one id the least in
    order is taken; class shares come from all rows that remain. Without any, every score is the same 0.5.
    """
    small_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    own = own.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most").cache()
    shares = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_per_class) for y in (0, 1)]
    chosen = picked[0].union(picked[1])
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 * sample_per_class rows at most
    texts = texts.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # one text an id, as ids may repeat
    texts = texts.select("y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).alias("fold"), "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            counts: Counter = Counter()
            for y, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((y, fold, w) for w in words_of(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["y", "fold", "word", "n"])

    cell = lambda y, f: F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n")).otherwise(0))
    # Three models: of each fold for the other's figures, and of both. Each is fitted in one task from the sample's words.
    parts = ((0, cell(0, 0), cell(1, 0)), (1, cell(0, 1), cell(1, 1)), (2, cell(0, 0) + cell(0, 1), cell(1, 0) + cell(1, 1)))
    counts = texts.mapInArrow(tally, "y int, fold int, word string, n bigint").groupBy("word").agg(F.array(*(F.struct(F.lit(k).alias("which"), a.alias("n0"), b.alias("n1")) for k, a, b in parts)).alias("c"))
    counts = counts.select("word", F.explode("c").alias("c")).select("word", "c.*").filter("n0 + n1 > 0")

    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = fit_ratios(zip(frame["word"], frame["n0"].tolist(), frame["n1"].tolist(), strict=True))
        return pd.DataFrame({"which": [key[0]], "model": [pickle.dumps(found)]})

    models = {r.which: bytes(r.model) for r in counts.groupBy("which").applyInPandas(train, "which int, model binary").collect()}
    empty = pickle.dumps(Ratios())
    folds = [models.get(k, empty) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        score = [Scorer(pickle.loads(r)) for r in shared.value]
        for batch in batches:
            ys, fs, xs = (c.to_pylist() for c in batch.columns)
            got = np.array([score[1 - f](x) for f, x in zip(fs, xs, strict=True)], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], ["y", "ratio", "excess"])
        score = batch = None
        give_back()

    seen = texts.mapInArrow(cross, "y int, ratio double, excess double").toPandas()
    shared.destroy()
    own.unpersist()
    del folds
    y = seen["y"].to_numpy(np.float64)
    taken = [max(1, int((y == k).sum())) for k in (0, 1)]
    weight = np.where(y == 1, shares.get(1, 0) / taken[1], shares.get(0, 0) / taken[0]) if len(y) else np.zeros(0)
    weight = weight * len(y) / weight.sum() if len(y) else weight
    whole = models.pop(2, empty)
    models.clear()
    give_back()  # the driver lives on as well
    return Toxicity(whole, *fit_logistic(seen["excess"].to_numpy(np.float64), y, weight, seen["ratio"].to_numpy(np.float64)))


def score_column(docs: DataFrame, model: Toxicity, text_col: str = "text") -> Column:
    """The probability that a row's text is toxic, from the text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        of = Scorer(pickle.loads(shared.value.ratios))
        for texts in batches:
            got = np.array([of(t) for t in texts], np.float64).reshape(-1, 2)
            yield pd.Series(shared.value.probability(got[:, 0], got[:, 1]), index=texts.index)
        del of
        give_back()

    return judge(text_or_empty(text_col))


def score(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (1 if score >= threshold, else 0).

    A null text is an empty one; a text without words scores like one without toxic words; very long texts are scored whole.
    Ids may repeat or be null, repeated rows score alike; other columns are ignored; an empty table gives an empty result.
    Nothing is shuffled.
    """
    scored = docs.select(F.col(id_col), score_column(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns as they were; nulls and empty tables as in score()."""
    keep = free_name(docs, "keep")
    return docs.withColumn(keep, score_column(docs, model, text_col) < threshold).filter(F.col(keep)).drop(keep)
