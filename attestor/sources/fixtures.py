"""Made-up cases: records, texts and expected answers of every outcome, as many as are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("differs", "agrees", "unknown component", "other revision", "not stated", "contradicts itself", "unit without conversion", "no number")


def cases(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, pages, expected) of n cases, the kinds in turn. A case's number decides all of it."""
    k = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    is_ = lambda *names: F.col("kind").isin(*names)
    text = lambda c: c.cast("string")
    rows = spark.range(n).select("id", kind.alias("kind"), (k % 90 + 10).alias("cm"), F.concat(F.lit("case-"), F.lpad(text(k), 9, "0")).alias("case_id"), F.concat(F.lit("FX-"), text(k)).alias("component"))
    stated = F.concat(F.lit("Outer height: "), text(F.col("cm")), F.when(is_("unit without conversion"), " ft").otherwise(" cm"), F.lit("."))
    body = F.when(is_("not stated"), F.lit("Outer weight: 4 kg.")).when(is_("contradicts itself"), F.concat(stated, F.lit("\nInner height: "), text(F.col("cm") + 1), F.lit(" cm."))).otherwise(stated)
    # The last digit of the component parts "unknown" texts from what is asked for.
    page = F.concat(F.lit("Component ID: "), "component", F.when(is_("unknown component"), "-b").otherwise(""), F.lit("\nRevision: "), F.when(is_("other revision"), "B").otherwise("A"), F.lit("\n1. Mechanical data\n"), body)
    pages = rows.select(F.concat("case_id", F.lit(".pdf")).alias("source_file"), F.lit(1).alias("page_number"), page.alias("text"))
    value = F.when(is_("no number"), "tall").when(is_("agrees"), text(F.col("cm") * 10)).otherwise("7")
    records = rows.select("case_id", F.col("component").alias("component_id"), F.lit("A").alias("revision"), F.lit("height").alias("attribute_name"), value.alias("recorded_value"), F.lit("mm").alias("recorded_unit"))
    outcome = F.when(is_("differs"), "correction_proposed").when(is_("agrees"), "no_change").when(is_("contradicts itself"), "ambiguous_evidence").when(is_("unit without conversion", "no number"), "needs_review").otherwise("insufficient_evidence")
    cites = is_("differs", "agrees", "unit without conversion")
    expected = rows.select(
        "case_id", outcome.alias("expected_outcome"), F.when(is_("differs"), (F.col("cm") * 10).cast("double")).alias("expected_value"), F.when(is_("differs"), "mm").alias("expected_unit"),
        F.when(cites, F.concat("case_id", F.lit(".pdf"))).alias("expected_file"), F.when(cites, 1).alias("expected_page"), F.when(cites, stated).alias("expected_passage"),
    )
    return records, pages, expected


def write_cases(spark: SparkSession, n: int, folder: str) -> None:
    """The cases as JSON lines in records, pages and expected, as the readers take them."""
    records, pages, expected = cases(spark, n)
    records.write.mode("overwrite").json(f"{folder}/records")
    pages.select("source_file", F.array(F.struct("page_number", "text")).alias("pages")).write.mode("overwrite").json(f"{folder}/pages")
    correction = F.when(F.col("expected_value").isNotNull(), F.struct(F.col("expected_value").alias("value"), F.col("expected_unit").alias("unit")))
    evidence = F.when(F.col("expected_file").isNotNull(), F.struct(F.col("expected_file").alias("document_filename"), F.col("expected_page").alias("page_number"), F.col("expected_passage").alias("supporting_passage")))
    expected.select("case_id", "expected_outcome", correction.alias("expected_correction"), evidence.alias("expected_evidence")).write.mode("overwrite").json(f"{folder}/expected")
