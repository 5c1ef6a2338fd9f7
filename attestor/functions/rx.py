"""Patterns as columns: values are quoted into Java regular expressions, and no group repeats, so long texts are safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How numbers, units, ids and headings are written, and the labels of a text's identity further below.
NUMBER, UNIT = r"(\d+(?:\.\d+)?)", r"([a-zA-Zµ°Ω%]+)"
#: A run of words before an attribute.
LEAD = r"(?:[A-Za-z0-9_-][A-Za-z0-9_\s-]*\s)?"
ID = "[A-Za-z0-9_-]"
#: Section words that mark the dimensions of a part.
SECTION_WORDS = ("dimension", "parameter", "specification", "mechanical", "physical")


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def quote(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def strip(c: Column) -> Column:
    """Without the white space of Unicode at both ends; trim() alone takes blanks only."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """Null for null and empty."""
    return F.nullif(c, F.lit(""))


def extract(text: Column, pattern: Column | str, group: int) -> Column:
    """The group of the first match; empty without one."""
    return F.call_function("regexp_extract", text, lit(pattern), F.lit(group))


def extract_all(text: Column, pattern: Column | str, group: int) -> Column:
    return F.regexp_extract_all(text, lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def component(id_: Column) -> Column:
    return F.concat(F.lit(rf"(?iU)(?<!{ID})"), quote(id_), F.lit(rf"(?!{ID})"))


def revision(value: Column) -> Column:
    own = F.regexp_replace(strip(value), r"(?iU)^(?:revision|rev)\.?\s*", "")
    return F.concat(F.lit(r"(?iU)\b(?:rev(?:ision)?\.?)\s*:?\s*"), quote(own), F.lit(rf"(?!{ID})"))


def mention(attribute: Column) -> Column:
    return F.concat(F.lit(r"(?iU)\b"), quote(attribute), F.lit(r"\b"))


def direct(attribute: Column) -> Column:
    return F.concat(F.lit(rf"(?iU)^{LEAD}"), quote(attribute), F.lit(rf"\s*(?:[:=]|\bis\b)\s*{NUMBER}\s*{UNIT}(?:\s*[±+/-]\s*\d+(?:\.\d+)?\s*[a-zA-Zµ°Ω%]+)?[.;]?$"))


def forward(attribute: Column) -> Column:
    return F.concat(F.lit(r"(?iU)\b"), quote(attribute), F.lit(rf"\b[^\n.!?]*?(?:[:=]|\bis\b)?\s*{NUMBER}\s*{UNIT}"))


def backward(attribute: Column) -> Column:
    return F.concat(F.lit(rf"(?iU){NUMBER}\s*{UNIT}\s+{LEAD}"), quote(attribute))


FIRST_LINE = rf"(?iU)^\s*{LEAD}{NUMBER}\s*{UNIT}"
HEADING = r"(?<=\n)(?=\d+\.\s+[A-Za-z])"
IDENTITY = {
    "component_id": rf"(?iU)(?:Component ID|Part Number)\s*:\s*({ID}+)",
    "revision": rf"(?iU)(?:Revision|Rev\.?)\s*:\s*({ID}+)",
    "document_id": rf"(?iU)Document ID\s*:\s*({ID}+)",
}


def aligned(quoted: Column) -> Column:
    """Windows of the same words, whatever white space parts them; a look-ahead finds overlapping ones too."""
    words = F.transform(F.split(strip(quoted), r"(?U)\s+"), quote)
    return F.concat(F.lit(r"(?U)(?=((?<!\S)"), F.array_join(words, r"\s+"), F.lit(r"(?!\S)))"))


def matches_component(text: Column, id_: Column) -> Column:
    return F.rlike(text, component(id_))


def matches_revision(text: Column, value: Column) -> Column:
    """A missing revision matches any text."""
    return F.when(blank(strip(value)).isNull(), F.lit(True)).otherwise(F.rlike(text, revision(value)))


def section_or_page(text: Column, attribute: Column) -> Column:
    """struct(passage, context_type): the section that mentions the attribute, preferring one about dimensions, else the page."""
    parts = F.filter(F.transform(F.split(text, HEADING), strip), lambda s: (s != "") & F.rlike(s, mention(attribute)))
    about = lambda s: F.rlike(F.lower(F.substring_index(s, "\n", 1)), F.lit("|".join(SECTION_WORDS)))
    own = F.coalesce(F.get(F.filter(parts, about), F.lit(0)), F.get(parts, F.lit(0)))
    own = F.when(F.rlike(text, F.lit(r"(?:^|\n)\d+\.\s+[A-Za-z]")), own)
    return F.struct(F.coalesce(own, strip(text)).alias("passage"), F.when(own.isNull(), "page").otherwise("section").alias("context_type"))
