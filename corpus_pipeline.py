"""From raw documents to token counts: toxicity, exact and near copies, benchmark passages, then the tokenizer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestor.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from attestor.llm.common import drop_folders, folders_made, stored, table
from attestor.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled rows of the whole table that aren't held out; rejects scores of THRESHOLD or more. Rows with null or
    empty texts score alike, as texts without toxic words; repeated rows share their fate; null ids are kept or dropped by their text."""
    return toxicity.drop_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, as in op10. Null texts equal empty ones; a null id loses against all
    others; of rows that share text and id one stays."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8 or more; the smallest doc_id of a group stays. Texts without words and rows
    with a null id are linked with nothing and stay; rows that share an id stay or go together."""
    return near_dedup.drop_near_copies(docs, shingle=5, threshold=(80, 100))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold question and answer of a benchmark item. Null and empty texts hold none, an empty benchmark drops nothing,
    and repeated rows and null ids are judged by their text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: n_tokens and the digests of the ids and of what they decode to; a null text is an empty one, and ids may repeat or be null."""
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("bpe", tokenize),
]

#: SQL can't express the models and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored, and what it has stored on its way is deleted. Null and empty texts, very long ones,
    repeated rows and null ids go through as the stages' operators say; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = set(folders_made())
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_folders(spark, [f for f in folders_made() if f not in before and f"stage-{name}" not in f])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
