"""Measurements: extraction from a passage, grounding of quotes, and exact conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import rx

#: Values have up to 18 digits before the point and 16 after it, so that ten times a value and a tenth of it are exact.
VALUE, CONVERTED = "decimal(34,16)", "decimal(38,17)"
#: Fixed value: units that convert.
UNITS = ("mm", "cm")
#: Words before a label of a tuple that don't belong to it.
LABEL_LEAD = r"(?U)^(?:nominal|package|component)\s+"


def supported(unit: Column) -> Column:
    return F.coalesce(F.lower(rx.strip(unit)).isin(*UNITS), F.lit(False))


def numeric(text: Column) -> Column:
    """Whether the text is a finite decimal."""
    return F.coalesce(F.rlike(rx.strip(text), F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), F.lit(False))


def decimal(text: Column) -> Column:
    """Null if the text isn't a finite decimal, or has more digits than VALUE, as nothing is rounded."""
    own = rx.strip(text)
    digits = F.length(F.regexp_extract(own, r"\.(\d*?)0*(?:[eE]|$)", 1))
    power = F.coalesce(F.regexp_extract(own, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    short = F.rlike(own, F.lit(r"^[+-]?\d{1,18}(\.\d{1,16})?$"))  # most are: nothing more has to be looked at
    return F.when(short, own.try_cast(VALUE)).when(numeric(text) & (digits - power <= 16), own.try_cast("decimal(38,18)").try_cast(VALUE))


def direct_line(line: Column, attribute: Column) -> Column:
    """struct(value double, unit, line), or null if the line isn't a direct specification."""
    pattern = rx.direct(attribute)
    own = rx.strip(line)
    return F.when(F.rlike(own, pattern), F.struct(rx.extract(own, pattern, 1).cast("double").alias("value"), F.lower(rx.extract(own, pattern, 2)).alias("unit"), own.alias("line")))


def direct_lines(text: Column, attribute: Column) -> Column:
    """array<struct(value, unit, line, at)> of a page's or chunk's direct specifications, in order."""
    found = F.transform(rx.lines(text), lambda l, i: F.struct(direct_line(l, attribute).alias("f"), i.alias("at")))
    return F.transform(F.filter(found, lambda x: x["f"].isNotNull()), lambda x: F.struct(x["f"]["value"].alias("value"), x["f"]["unit"].alias("unit"), x["f"]["line"].alias("line"), x["at"].alias("at")))


def labelled_tuple(passage: Column, attribute: Column) -> Column:
    """struct(value_text, unit, quote, error) of the first line that settles what stands at the attribute's label, else null."""
    attr = F.lower(rx.strip(attribute))
    last_word = F.element_at(F.split(attr, r"(?U)\s+"), -1)

    def settle(line: Column) -> Column:
        own = rx.strip(line)
        head, body = rx.strip(F.regexp_extract(own, r"(?s)^([^:=]*)[:=](.*)$", 1)), rx.strip(F.regexp_extract(own, r"(?s)^([^:=]*)[:=](.*)$", 2))
        group = F.regexp_extract(head, r"[(\[]([^)\]]+)[)\]]", 1)
        named = F.when(group != "", rx.strip(group)).otherwise(head)
        by = F.when(F.contains(named, F.lit(",")), F.split(named, ",")).when(F.rlike(named, F.lit(r"(?U)\s[xX×/]\s")) & ~F.rlike(named, F.lit(r"(?U)\d")), F.split(named, r"(?U)\s+[xX×/]\s+"))
        labels = F.filter(F.transform(by, lambda x: F.lower(rx.strip(x))), lambda x: x != "")
        bare = lambda x: rx.strip(F.regexp_replace(x, LABEL_LEAD, ""))
        hits = F.filter(F.transform(labels, lambda x, i: F.when((x == attr) | (bare(x) == attr) | (bare(x) == last_word), i)), lambda i: i.isNotNull())
        item = r"(\d+(?:\.\d+)?)\s*([a-zA-Zµ°Ω%]+)?"
        values, units = rx.extract_all(body, item, 1), rx.extract_all(body, item, 2)
        at = F.get(hits, F.lit(0))
        unit = F.coalesce(rx.blank(F.get(units, at)), rx.blank(F.get(units, F.size(units) - 1)))
        said = lambda why: F.struct(F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("string").alias("unit"), own.alias("quote"), F.lit(why).alias("error"))
        ok = F.struct(F.get(values, at).alias("value_text"), F.lower(unit).alias("unit"), own.alias("quote"), F.lit(None).cast("string").alias("error"))
        result = F.when(F.size(hits) > 1, said("the attribute names several positions of the tuple")).when(F.size(values) == 0, said("the tuple has no numbers")).when(F.size(labels) != F.size(values), said("the tuple has other numbers of labels and values")).when(unit.isNull(), said("the tuple's value has no unit")).otherwise(ok)
        fits = F.contains(F.lower(own), attr) & (head != "") & (body != "") & labels.isNotNull() & (F.size(labels) >= 2) & (F.size(hits) >= 1)
        return F.when(fits, result)

    return F.get(F.filter(F.transform(rx.lines(passage), settle), lambda x: x.isNotNull()), F.lit(0))


def extraction(passage: Column, attribute: Column) -> Column:
    """struct(status, name, value_text, unit, quote, error): tuples first, then number after, before, or on the first line."""
    found = labelled_tuple(passage, attribute)
    patterns = (rx.forward(attribute), rx.backward(attribute), F.lit(rx.FIRST_LINE))

    def pick(p: Column) -> Column:
        return F.when(F.rlike(passage, p), F.struct(F.lit("found").alias("status"), attribute.alias("name"), rx.extract(passage, p, 1).alias("value_text"), F.lower(rx.extract(passage, p, 2)).alias("unit"), rx.strip(rx.extract(passage, p, 0)).alias("quote"), F.lit(None).cast("string").alias("error")))

    null = F.lit(None).cast("string")
    none = F.struct(F.lit("insufficient").alias("status"), null.alias("name"), null.alias("value_text"), null.alias("unit"), null.alias("quote"), F.lit("no measurement").alias("error"))
    of_tuple = F.when(found.isNotNull(), F.struct(F.when(found["error"].isNull(), "found").otherwise("error").alias("status"), attribute.alias("name"), found["value_text"].alias("value_text"), found["unit"].alias("unit"), found["quote"].alias("quote"), found["error"].alias("error")))
    return F.when(rx.blank(passage).isNull(), none).otherwise(F.coalesce(of_tuple, *(pick(p) for p in patterns), none))


def alignment(quoted: Column, passage: Column) -> Column:
    """struct(kind, span): literal or whitespace_aligned with the passage's own span, else missing or ambiguous."""
    q = quoted
    times = ((F.length(passage) - F.length(F.replace(passage, q, F.lit("")))) / F.length(q)).cast("int")
    windows = F.when(rx.blank(rx.strip(q)).isNotNull(), rx.extract_all(passage, rx.aligned(q), 1))
    null = F.lit(None).cast("string")
    of = lambda kind, span: F.struct(F.lit(kind).alias("kind"), span.alias("span"))
    return (
        F.when(rx.blank(rx.strip(F.coalesce(q, F.lit("")))).isNull() | passage.isNull(), of("missing", null))
        .when(times == 1, of("literal", q))
        .when(times > 1, of("ambiguous", null))
        .when(F.size(windows) == 1, of("whitespace_aligned", F.get(windows, F.lit(0))))
        .when(F.size(windows) > 1, of("ambiguous", null))
        .otherwise(of("missing", null))
    )


def shown(value_text: Column) -> Column:
    """The number as text without leading zeros, as it must stand in a quote. One under a millionth is written with an
    exponent, which no quote has."""
    tiny = (F.abs(value_text.try_cast("double")) < 1e-6) & F.rlike(value_text, F.lit(r"^\d*\.(?:\d{7,}|\d*[1-9]\d*)$"))
    return F.when(tiny, "\0").otherwise(F.regexp_replace(value_text, r"^0+(?=\d)", ""))


def factor(unit_from: Column, unit_to: Column) -> Column:
    """10, 0.1 or 1; null for a unit that doesn't convert."""
    a, b = F.lower(rx.strip(unit_from)), F.lower(rx.strip(unit_to))
    return F.when(~supported(a) | ~supported(b), F.lit(None)).when(a == b, F.lit("1")).when((a == "cm") & (b == "mm"), F.lit("10")).otherwise(F.lit("0.1")).cast("decimal(3,1)")


def converted(value: Column, unit_from: Column, unit_to: Column) -> Column:
    return (value.cast(VALUE) * factor(unit_from, unit_to)).cast(CONVERTED)


def plain(value: Column) -> Column:
    """A decimal as text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(?<=\.\d{0,17}[1-9])0+$|\.0+$", ""), r"^-?0[eE].*$", "0")


def calculation(value: Column, unit_from: Column, unit_to: Column) -> Column:
    """The conversion in words: 0.8 cm x 10 = 8 mm."""
    say = lambda v, u: F.concat_ws(" ", plain(v), F.lower(rx.strip(u)))
    return F.concat(say(value.cast(VALUE), unit_from), F.lit(" x "), plain(factor(unit_from, unit_to)), F.lit(" = "), say(converted(value, unit_from, unit_to), unit_to))


def comparison(evidence_value: Column, evidence_unit: Column, recorded_value: Column, recorded_unit: Column) -> Column:
    """struct(converted, multiplier, calculation, agrees) of decimal texts; null where a unit or a value doesn't convert."""
    own, there = decimal(recorded_value), decimal(evidence_value)
    value = converted(there, evidence_unit, recorded_unit)
    return F.when(
        value.isNotNull() & own.isNotNull(),
        F.struct(value.alias("converted"), factor(evidence_unit, recorded_unit).alias("multiplier"), calculation(there, evidence_unit, recorded_unit).alias("calculation"), (own.cast(CONVERTED) == value).alias("agrees")),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def finite(vec: Column) -> Column:
    return F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def token_estimate(text: Column) -> Column:
    """Words times 1.4, floored, plus 2."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (F.floor(words.cast("double") * F.lit(1.4)) + 2).cast("int")


def sanitize(message: Column) -> Column:
    """Masks passwords and paths."""
    return F.regexp_replace(F.regexp_replace(message, r"(?i)password\s*=\s*\S+", "password=***"), r"(?:/[\w.-]+){2,}", "[path]")
