"""Removal of lines that many documents share.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, and the lines of hashes over the
threshold are looked up again: what comes back for a document is the positions of its dropped lines, from which the
rest is put together in order. Texts are shuffled once, to meet their positions; what is counted are hashes of 128 bits.
All of it is DataFrame code. A line that a third of all documents hold is counted by (hash, document) first and by hash
with partial sums then, and the look-up is a join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ascii_lower, stored, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"


def normalized(line: Column) -> Column:
    """The line without blanks (\\x20, \\x09-\\x0D) at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, of, at, h for each line of docs (id, of, text) with min_chars code points or more; h: 128 bits of a cryptographic hash."""
    lines = docs.select("id", "of", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select("id", "of", "at", normalized(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("id", "of", "at", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h, top: hashes that min_docs distinct ids or more hold, and the largest of these. A null id is one of its own and the smallest."""
    pairs = lines.select("h", "id").distinct()
    counted = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    return counted.filter(F.col("n") >= min_docs).select("h", "top")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, kept (the lines that stay, joined by \\n).

    Lines end at \\n; a null or empty text is one empty line. A line whose normalised form has min_chars code points or
    more and stands in min_docs documents or more goes, all times it stands there, but from the document with the largest id that
    holds it. Rows with the same id are one document when documents are counted, and each is cut by itself; a null id is a
    document of its own, smaller than all others. Very long texts are cut whole; lines may be as long as their text. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("of", F.xxhash64("text"))
    lines = line_hashes(rows, min_chars)
    # stored, so that both sides of the join are dealt out for it alone, which lets Spark split the partition of a common line
    shared = stored(shared_lines(lines, min_docs), "shared-lines")
    gone = lines.join(shared, "h").filter(~F.col("id").eqNullSafe(F.col("top")))
    # at most the lines of one document; rows that are wholly equal give the same positions
    dropped = gone.groupBy("id", "of").agg(F.collect_set("at").alias("dropped")).select(F.col("id").alias("own_id"), F.col("of").alias("own_of"), "dropped")
    met = rows.join(dropped, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("of") == F.col("own_of")), "left")
    cut = met.select("id", "text", "dropped", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return cut.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
