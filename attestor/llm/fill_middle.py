"""Fill-in-the-middle: texts cut into prefix, middle and suffix at ends of units, and put in an order that ends with the middle.

An Arrow-batched pandas UDF lets the regex library find the units; their end offsets stand in a compact array, so each cut
is one lookup. Draws come from a hash of the seed and the row's identifier: they hang neither on partitions nor on order,
so that a task that is run again gives the same rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import small_batches, text_or_empty, trim

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Units: code points, and words with the space behind them.
CHARS, WORDS = r"(?s:.)", r"\S+\s*|\s+"


@dataclass(frozen=True)
class Marks:
    """What stands before each part. None may be a part of another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


def draws(seed: str, key: str) -> list[int]:
    """Four unsigned 32-bit numbers of (seed, key): the first groups of eight digits of the hash."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """Code point offsets at which units end, left to right."""
    return array("I", (m.end() for m in unit.finditer(text, concurrent=False)))


def transformed(text: str, numbers: list[int], unit: regex.Pattern, marks: Marks, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the output."""
    ends = unit_ends(unit, text)
    n, (h1, h2, h3, h4) = len(ends), numbers
    if not text or h3 % 100 >= plain_from or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, SPM, a, b - a, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return n, PSM, a, b - a, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def rebuilt(output: str, form: str, marks: Marks) -> str:
    """The text from output and form alone. A text with a mark in it is plain, and the first mark found is the one put in, as
    no mark can begin within another."""
    if form == PLAIN:
        return output
    first, second = (marks.suffix, marks.prefix) if form == SPM else (marks.prefix, marks.suffix)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(marks.middle)
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return prefix + middle + suffix


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """As rebuilt, as an expression; null where output or form is."""
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    return F.when(form == PLAIN, output).when(form == SPM, F.concat(part[2], part[3], part[1])).when(form == PSM, F.concat(part[1], part[3], part[2]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = CHARS, plain_percent: int = 10, spm_percent: int = 20, marks: Marks = Marks(), outputs: bool = True) -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, and output if outputs.

    unit is a pattern of the regex library whose matches aren't empty; what no unit covers goes with the unit after it, or
    with the suffix. Each of the two cuts falls behind 0 to n units. plain_percent of the rows stay as they are, as do empty texts
    and those in which a mark stands; of the others spm_percent have the suffix first. prefix_chars and middle_chars count
    code points and are null in plain rows. restored_sha256 hashes the text that rebuilt() makes of output and form.

    A null text is an empty one. Rows that share an id share their draws; a null id draws as an empty one. Very long texts
    are cut whole, at four bytes a unit. Other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    if len(set(marks)) < 3 or any(not m or m in o for m in marks for o in marks if m is not o) or any(m[i:] == o[: len(m) - i] for m in marks for o in marks for i in range(1, len(m))):
        raise ValueError("no mark may be empty, lie in another or begin within one")
    if regex.compile(unit).match(""):
        raise ValueError("a unit must not be empty")
    small_batches(docs.sparkSession)
    fields = ["n bigint", "form string", "prefix_chars bigint", "middle_chars bigint", "output_sha256 string", "restored_sha256 string", *["output string"] * outputs]

    @F.pandas_udf(", ".join(fields))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for keys, texts in batches:
            rows = []
            for key, text in zip(keys, texts, strict=True):
                n, form, prefix, middle, output = transformed(text, draws(seed, key), pattern, marks, 100 - plain_percent, spm_percent)
                rows.append((n, form, prefix, middle, digest(output), digest(rebuilt(output, form, marks)), *[output] * outputs))
            frame = pd.DataFrame(rows, columns=[f.split()[0] for f in fields])
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
            keys = texts = rows = frame = text = output = None
            trim()

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), cut(key, text_or_empty(text_col)).alias("cut")).select(F.col("id").alias(id_col), "cut.*")
