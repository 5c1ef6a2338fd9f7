"""Exact deduplication by sorting content.

The normalised bytes are range-partitioned at sampled splitters, sorted externally within each range, so that equal
texts become neighbours, and neighbours are compared in full. All of it is DataFrame code.

A text that makes up much of the table would fill one range. A bounded sample of rows finds such texts; their rows get
a salt as second sort key, so that the splitters can cut between salts. The sample decides only where rows go: each
salted run is compared in full as well, and the runs of one text, at most SALTS of them, are merged by full comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import ascii_lower, stored, text_or_empty

#: Rows sampled to find hot texts, the hits in the sample that make a text hot, and the runs that its rows are split into.
HOT_SAMPLE, HOT_HITS, SALTS = 20_000, 40, 64
#: Characters of a text that its splitters show.
HEAD = 32


def hot_hashes(norm: DataFrame) -> list[int]:
    """At most HOT_SAMPLE / HOT_HITS hashes of texts that each hold about HOT_HITS / HOT_SAMPLE of the rows or more."""
    rows = norm.count()
    if rows < HOT_SAMPLE:
        sample, hits = norm, HOT_HITS
    else:
        sample, hits = norm.sample(HOT_SAMPLE / rows, seed=7), HOT_HITS
    found = sample.groupBy(F.xxhash64("norm").alias("h")).count().filter(F.col("count") >= hits)
    return [r.h for r in found.orderBy(F.desc("count"), "h").limit(2 * HOT_SAMPLE // HOT_HITS).collect()]


def _runs(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool) -> tuple[DataFrame, Column, Callable, list[int]]:
    """The sorted runs of equal texts: id, norm, salt, rn, run_id, run_size, and the whole row if carry."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    order: Column = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    best = F.max if keep == "largest" else F.min
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm"), *row)
    hot = hot_hashes(norm.select("norm"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    norm = norm.withColumn("salt", F.when(F.xxhash64("norm").isin(hot), salt).otherwise(F.lit(-1)) if hot else F.lit(-1))
    # Splitters are sampled rows that the driver sorts, so they are made of a prefix and a hash instead of whole texts.
    # Equal texts have both in common. The windows need the rows of a run together, which the ranges already grant, and
    # their sort by prefix, hash and text makes equal texts neighbours.
    norm = norm.withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm")})
    ranged = norm.repartitionByRange("head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "norm", "salt")
    runs = ranged.withColumns({"rn": F.row_number().over(run.orderBy(order)), "run_id": best("id").over(run), "run_size": F.count(F.lit(1)).over(run)})
    return runs, order, best, hot


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep is "largest" or "smallest" and
    names the identifier that stays. Null identifiers lose against all others; of several rows that share text and
    identifier exactly one is kept; a group with only null identifiers keeps one row and has a null keep_id. Very long
    texts are compared whole. An empty table gives an empty result. Other columns are ignored.
    """
    runs, _, best, hot = _runs(docs, id_col, text_col, keep, carry=False)
    runs = runs.select("id", F.sha2("norm", 256).alias("text_sha256"), "salt", "rn", "run_id", "run_size", F.when((F.col("rn") == 1) & (F.col("salt") >= 0), F.col("norm")).alias("hot_norm"))
    if hot:
        runs = stored(runs, "runs")
        merged = (
            runs.filter(F.col("hot_norm").isNotNull())
            .groupBy("hot_norm")
            .agg(best("run_id").alias("all_id"), F.sum("run_size").alias("all_size"), F.min("salt").alias("first_salt"))
            .select(F.sha2("hot_norm", 256).alias("text_sha256"), "all_id", "all_size", "first_salt", F.lit(0).alias("hot"))
        )
        # len(hot) rows at most, a few dozen bytes each
        runs = runs.withColumn("hot", F.when(F.col("salt") >= 0, 0)).join(F.broadcast(merged), ["text_sha256", "hot"], "left")
    else:
        runs = runs.withColumns({"all_id": F.col("run_id"), "all_size": F.col("run_size"), "first_salt": F.lit(-1)})
    keep_id = F.when(F.col("salt") >= 0, F.col("all_id")).otherwise(F.col("run_id"))
    winner = F.when(F.col("salt") < 0, F.lit(True)).when(F.col("all_id").isNull(), F.col("salt") == F.col("first_salt")).otherwise(F.coalesce(F.col("run_id") == F.col("all_id"), F.lit(False)))
    return runs.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(F.col("salt") >= 0, F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("rn") == 1) & winner).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_groups marks as kept, one for each text, with all their columns.

    The rows travel with their keys through the one sort, so nothing is joined back. Of rows that share text and
    identifier one stays; nulls and empty tables as in exact_groups.
    """
    runs, order, _, hot = _runs(docs, id_col, text_col, keep, carry=True)
    first = runs.filter(F.col("rn") == 1)
    if not hot:
        return first.select("row.*")
    first = stored(first.select("id", "norm", "salt", "row"), "firsts")
    # at most SALTS rows for each of the hot texts
    best = first.filter("salt >= 0").withColumn("rn", F.row_number().over(Window.partitionBy("norm").orderBy(order))).filter("rn = 1")
    return first.filter("salt < 0").select("row.*").union(best.select("row.*"))
