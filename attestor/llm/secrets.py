"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger records which (blob, rule version)
pairs have been scanned and what was found; a scan reads only pairs that the ledger lacks, once for each blob, and joins
the findings back to all paths that hold the blob. All of it is DataFrame code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import text_or_empty

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Numbers that are summed one by one.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least least characters. Matches are leftmost and don't overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds in their order. For access and hex the least length is part of the pattern: a run of one
# character class is matched whole or not at all, so the filtered matches are the same.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _sums_before(numbers: Column) -> Column:
    """For each of the numbers the sum of those before it, block by block, so that many of them take little more than their number."""
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
    inner = lambda part, base: F.transform(part, lambda _, i: base + _total(F.slice(part, 1, i)))
    outer = lambda x, sums: F.flatten(F.transform(x, lambda part, b: _bound(_total(F.slice(sums, 1, b)), lambda base: inner(part, base))))
    return _bound(numbers, lambda n: _bound(parts(n), lambda x: _bound(F.transform(x, _total), lambda sums: outer(x, sums))))


def _spans(text: Column, rule: Rule, index: int) -> Column:
    """Matches in code points: a match starts after the gaps and matches before it."""
    pat = F.lit(rule.pattern)
    lengths = lambda x: F.transform(x, F.length)
    hits = F.arrays_zip(lengths(F.regexp_extract_all(text, pat, F.lit(0))).alias("hit"), lengths(F.regexp_extract_all(text, pat, F.lit(rule.group))).alias("own"))

    def spans(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda h, i: F.get(x["gap"], i) + h["hit"])
        found = F.transform(F.arrays_zip(x["hits"].alias("h"), _sums_before(steps).alias("before")), lambda r, i: F.struct(
            (r["before"] + F.get(x["gap"], i)).alias("start"), F.lit(index).alias("kind"), (r["before"] + F.get(x["gap"], i) + r["h"]["hit"]).alias("end"), r["h"]["own"].alias("own")))
        return F.transform(F.filter(found, lambda r: r["own"] >= rule.least), lambda r: F.struct(r["start"], r["kind"], r["end"]))

    both = F.struct(lengths(F.split(text, rule.pattern, -1)).alias("gap"), hits.alias("hits"))
    return F.when(text.rlike(rule.pattern), _bound(both, spans).cast(SPAN)).otherwise(F.array().cast(SPAN))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches in a text as array<struct<start, kind, end>>, by start, then by the kind's place among the rules."""
    return F.array_sort(F.concat(*(_spans(text, r, i) for i, r in enumerate(rules))))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


class BlobLedger:
    """A Parquet folder of (blob, rule_version, spans), one row for each scanned pair; appended to, never rewritten."""

    SCHEMA = f"blob string, rule_version string, spans {SPAN}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def scan(self, versions: DataFrame, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans the unseen blobs of versions and returns one row per version: path, blob, spans.

        A null text is an empty one; null paths are kept; repeated rows come back as often as they came; very long texts
        are scanned whole; other columns are ignored. An empty table adds nothing to the ledger. If the append is lost with the job, the next scan takes the same blobs again.
        """
        own = rule_version(rules)
        listed = versions.select(F.col(path_col).alias("path"), text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
        seen = self.read().filter(F.col("rule_version") == own)
        # Only digests are grouped. Each unseen blob is then read at one path, so texts move once at most, spread by path,
        # and not at all where few blobs are new, as the join then broadcasts their list.
        unseen = listed.groupBy("blob").agg(F.min("path").alias("at")).join(seen.select("blob"), "blob", "left_anti")
        todo = listed.join(unseen.withColumnRenamed("blob", "b"), F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b")))
        found = todo.select("blob", spans_of(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])
        found.select("blob", F.lit(own).alias("rule_version"), "spans").write.mode("append").parquet(self.path)
        known = self.read().filter((F.col("rule_version") == own) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
        back = listed.select("path", "blob").join(known, "blob", "left")
        return back.select(F.col("path"), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
