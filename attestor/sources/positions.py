"""Rows by their place: running sums in a given order, and lines of files by their number, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.sources import readers
from attestor.sources.shared import stored

#: A row's id is its partition's number, and below that many bits its place there.
_BITS = 33


def running(rows: DataFrame, order: tuple[str | Column, ...], name: str = "position", amount: Column | None = None) -> DataFrame:
    """rows with the sum of amount over all rows before each, or how many these are.

    Rows are sorted by ranges and stored, so places stay what they are; what a partition begins with is a sum over one row for each
    partition. Rows that tie in order stand in any order. A null amount counts as 0. Raises if rows have a column of that name.
    """
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"rows have a column {name!r} already")
    own = rows.sort(*order).withColumn("__at", F.monotonically_increasing_id())
    own = own.withColumn("__n", F.lit(1).cast("bigint") if amount is None else F.coalesce(amount.cast("bigint"), F.lit(0).cast("bigint")))
    held = stored(own, "running").withColumn("__part", F.shiftright("__at", _BITS))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("__part").agg(F.sum("__n").alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(earlier(Window.orderBy("__part"))), F.lit(0)))
    within = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1)) if amount is None else F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__part").orderBy("__at"))), F.lit(0))
    met = held.withColumn("__within", within).join(F.broadcast(starts.select("__part", "__start")), "__part")  # one row for each partition of the sort
    return met.select(*rows.columns, (F.col("__start") + F.col("__within")).alias(name))


def by_number(file: Column) -> tuple[Column, Column]:
    """Orders files by the number behind "part-", without one first, and then by name."""
    return F.regexp_extract(file, r"/part-(\d{1,18})[^/]*$", 1).try_cast("bigint").asc_nulls_first(), file.asc()


def lines(spark: SparkSession, path: str, schema: str, name: str = "position") -> DataFrame:
    """The JSON objects of the lines of files, in the columns of schema, and each one's number over all files, blank lines left out.

    Files are split; lines of a block are counted where it is read, and the blocks before it are summed up. As a line that
    isn't an object would leave a place without a row, one fails this with a ValueError.
    """
    rows = readers.scan(spark, path, schema, readers.LINES).select("file", "block", "o", "error", F.monotonically_increasing_id().alias("__at"))
    held = stored(rows, "lines")
    bad = held.filter("error is not null").select("file", "error").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: {bad[0].error}")
    blocks = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))  # the ids of a block's lines follow each other
    starts = running(blocks, (*by_number(F.col("file")), "block"), "start", F.col("n")).drop("n")
    return held.join(starts, ["file", "block"]).select((F.col("start") + F.col("__at") - F.col("low")).alias(name), "o.*")
