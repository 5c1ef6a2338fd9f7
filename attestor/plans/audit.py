"""The audit: records in, one outcome each out. Stages are named, so the chain and the graph views share one plan."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attestor.functions import measure, rx
from attestor.operators import model, retrieve
from attestor.sources.shared import grown, stored

FIELDS = ("case_id", "record_id", "component_id", "part_number", "revision", "attribute_name", "attribute", "measurement", "recorded_value", "recorded_unit", "document_reference")
#: Outcomes, and the exits that lead to them in the order in which they are tried.
EXITS = (
    ("value_missing", "needs_review"), ("value_not_numeric", "needs_review"), ("value_out_of_range", "needs_review"), ("unit_unsupported", "needs_review"), ("retrieval_error", "needs_review"),
    ("insufficient", "insufficient_evidence"), ("ambiguous", "ambiguous_evidence"), ("no_passage", "insufficient_evidence"), ("extractor_error", "needs_review"),
    ("extractor_insufficient", "insufficient_evidence"), ("extractor_ambiguous", "ambiguous_evidence"), ("quote_unaligned", "needs_review"), ("wrong_attribute", "needs_review"),
    ("value_null", "needs_review"), ("value_ungrounded", "needs_review"), ("unit_ungrounded", "needs_review"), ("evidence_unit_unsupported", "needs_review"), ("conversion_error", "needs_review"),
    ("equal", "no_change"), ("differs", "correction_proposed"),
)
#: Nodes of the graph view that a record passes, by the first exit of each.
NODES = ("validate_record", "retrieve_evidence", "extract_measurement", "validate_evidence", "convert_and_compare")


#: The seven stages of the chain, in their order.
STAGES = ("load_record", "validate_record", "retrieve_evidence", "judge_retrieval", "extract_measurement", "validate_extraction", "compare_measurements")


def shown_names() -> dict[str, Column]:
    """How a record's component and attribute are called in its result, by what it says of them."""
    return {"component_id": F.coalesce("q_component", F.lit("UNKNOWN-COMP")), "attribute_name": F.coalesce("q_attribute", F.lit("unknown_attribute"))}


def outcome_of(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in EXITS for x in p))[code]


def normalize(records: DataFrame) -> DataFrame:
    """The record's fields as text, with their other names and placeholders; empty counts as missing."""
    f = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    first = lambda *cs: F.coalesce(*(rx.blank(f(c)) for c in cs), F.lit(None).cast("string"))
    extra = [F.col(c) for c in records.columns if c in ("query_vector", "corpus_id")]
    return records.select(
        F.coalesce(first("case_id", "record_id"), F.lit("UNKNOWN-CASE")).alias("case_id"),
        F.coalesce(first("record_id", "case_id"), F.lit("UNKNOWN-RECORD")).alias("record_id"),
        first("component_id", "part_number").alias("q_component"),
        f("revision").alias("revision"),
        first("attribute_name", "attribute", "measurement").alias("q_attribute"),
        f("recorded_value").alias("recorded_value"),
        f("recorded_unit").alias("recorded_unit"),
        F.coalesce(F.get_json_object(f("document_reference"), "$.filename"), F.when(~F.startswith(f("document_reference"), F.lit("{")), f("document_reference"))).alias("document_reference"),
        *extra,
    ).withColumns(shown_names())


def validate(records: DataFrame) -> DataFrame:
    value = measure.decimal(F.col("recorded_value"))
    code = F.when(F.col("recorded_value").isNull(), "value_missing").when(~measure.numeric(F.col("recorded_value")), "value_not_numeric").when(value.isNull(), "value_out_of_range").when(~measure.supported(F.col("recorded_unit")), "unit_unsupported")
    return records.withColumns({"recorded_decimal": value, "exit_code": code})


def asked(records: DataFrame) -> tuple[str, ...]:
    """The columns of normalised records that say what is asked."""
    return ("q_component", "revision", "q_attribute", "document_reference", *(c for c in records.columns if c == "corpus_id"))


def question_id(records: DataFrame) -> Column:
    return F.to_json(F.struct(*asked(records)), {"ignoreNullFields": "false"})


def questions_of(grouped: DataFrame) -> DataFrame:
    """From one row for what is asked to the question, with the other columns behind it."""
    rest = [c for c in grouped.columns if c not in asked(grouped) or c == "corpus_id"]
    return grouped.select(question_id(grouped).alias("qid"), F.col("q_component").alias("component"), "revision", F.col("q_attribute").alias("attribute"), retrieve.stem(F.col("document_reference")).alias("stem"), *rest)


def ask(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a question id where they are still open, and the distinct questions. Questions are grouped by all that
    they ask, so every use of them in a plan is the same aggregate, which Spark then makes once."""
    own = records.filter("exit_code is null")
    if "query_vector" in records.columns:
        questions = own.groupBy(*asked(records)).agg(F.first("query_vector").alias("query_vector"))
    else:
        questions = own.select(*asked(records)).distinct()
    return with_question(records), questions_of(questions)


def with_question(records: DataFrame) -> DataFrame:
    """Validated records with a question id where they are still open."""
    return records.withColumn("qid", F.when(F.col("exit_code").isNull(), question_id(records))).drop("query_vector")


def answer(questions: DataFrame, find: Callable[..., DataFrame], extractor: Callable[[DataFrame], DataFrame], observe: Callable[[str, DataFrame], DataFrame], **sources) -> DataFrame:
    """Passage, measurement and exit_code of each question. Nothing of it depends on what a record says, so records that
    ask the same share it. A plug-in extractor is handed the questions that are still open and no others."""
    found = find(questions, **sources)
    if "error_type" not in found.columns:
        found = found.withColumn("error_type", F.lit(None).cast("string"))
    found = observe(STAGES[2], found).withColumnRenamed("attribute", "attribute_name").withColumnRenamed("error_type", "retrieval_error").withColumn("exit_code", F.lit(None).cast("string"))
    found = observe(STAGES[3], judge_retrieval(found))
    if extractor is extract:
        found = extract(found)
    else:
        if getattr(extractor, "eager", False):  # its calls are a job of their own: what it is asked is found once
            found = stored(found, "found")
        live = extractor(found.filter("exit_code is null"))
        live = live.withColumn("x", model.completed(F.col("x"), live.schema["x"].dataType.names))
        found = live.unionByName(found.filter("exit_code is not null").withColumn("x", F.lit(None).cast(live.schema["x"].dataType)))
    return observe(STAGES[5], guard(observe(STAGES[4], found))).drop("attribute_name").withColumnRenamed("exit_code", "answer_code")


def judge_retrieval(records: DataFrame) -> DataFrame:
    s = F.col("retrieval_status")
    code = F.when(s == "error", "retrieval_error").when(s == retrieve.NONE, "insufficient").when(s == retrieve.SEVERAL, "ambiguous").when(rx.blank(F.col("passage")).isNull(), "no_passage")
    return records.withColumn("exit_code", F.coalesce("exit_code", code))


def extract(records: DataFrame) -> DataFrame:
    own = records.withColumn("x", F.when(F.col("exit_code").isNull(), measure.extraction(F.col("passage"), F.col("attribute_name"))))
    return own.withColumn("x", model.completed(F.col("x"), own.schema["x"].dataType.names))


def guard(records: DataFrame) -> DataFrame:
    records = records.withColumn("aligned", F.when(F.col("x.status") == "found", measure.alignment(F.col("x.quote"), F.col("passage"))))
    span, quote = F.coalesce("aligned.span", F.lit("")), F.coalesce("x.quote", F.lit(""))
    value, text = measure.decimal(F.col("x.value_text")), F.col("x.value_text")
    shown = measure.shown(F.col("x.value_text"))
    unit = F.lower(F.coalesce("x.unit", F.lit("")))
    name = F.lower(rx.strip(F.coalesce("x.name", F.lit(""))))
    code = (
        F.when(F.col("x.status") == "error", "extractor_error")
        .when(F.col("x.status") == "insufficient", "extractor_insufficient")
        .when(F.col("x.status") == "ambiguous", "extractor_ambiguous")
        .when(~F.col("aligned.kind").isin("literal", "whitespace_aligned"), "quote_unaligned")
        .when((name != "") & (name != F.lower(rx.strip(F.col("attribute_name")))), "wrong_attribute")
        .when(rx.blank(text).isNull() | ~measure.numeric(text), "value_null")
        .when(~(F.contains(quote, shown) | F.contains(span, shown)), "value_ungrounded")
        .when((unit != "") & ~(F.contains(F.lower(quote), unit) | F.contains(F.lower(span), unit)), "unit_ungrounded")
        .when(~measure.supported(F.col("x.unit")), "evidence_unit_unsupported")
    )
    return records.withColumns({"evidence_decimal": value, "exit_code": F.when(F.col("exit_code").isNull(), code).otherwise(F.col("exit_code"))})


def compare(records: DataFrame) -> DataFrame:
    there = measure.converted(F.col("evidence_decimal"), F.col("x.unit"), F.col("recorded_unit"))
    code = F.when(there.isNull(), "conversion_error").when(F.col("recorded_decimal").cast(measure.CONVERTED) == there, "equal").otherwise("differs")
    return records.withColumns({"converted": F.when(F.col("exit_code").isNull(), there), "exit_code": F.coalesce("exit_code", code)})


def explanation() -> Column:
    """Why a record ends as it does, from the columns of the plan."""
    c, text = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit("?"))
    stated = F.concat_ws(" ", measure.plain(c("evidence_decimal")), F.lower(rx.strip(c("x.unit"))))
    recorded = F.concat_ws(" ", c("recorded_value"), c("recorded_unit"))
    turned = measure.calculation(c("evidence_decimal"), c("x.unit"), c("recorded_unit"))
    proposed = F.concat_ws(" ", measure.plain(c("converted")), F.lower(rx.strip(c("recorded_unit"))))
    said = {
        "value_missing": F.lit("the record has no value"),
        "value_not_numeric": F.concat(F.lit("the recorded value isn't a number: "), text("recorded_value")),
        "value_out_of_range": F.concat(F.lit("the recorded value has too many digits: "), text("recorded_value")),
        "unit_unsupported": F.concat(F.lit("the recorded unit isn't supported: "), text("recorded_unit")),
        "retrieval_error": F.concat(F.lit("the search failed: "), F.coalesce("reason", "retrieval_error", F.lit("?"))),
        "insufficient": F.coalesce("reason", F.lit("no evidence was found")),
        "ambiguous": F.coalesce("reason", F.lit("the evidence contradicts itself")),
        "no_passage": F.lit("the search gave no passage"),
        "extractor_error": F.concat(F.lit("the extraction failed: "), text("x.error")),
        "extractor_insufficient": F.coalesce("x.error", F.concat(F.lit("the passage doesn't state "), c("attribute_name"))),
        "extractor_ambiguous": F.coalesce("x.error", F.concat(F.lit("the passage states several values of "), c("attribute_name"))),
        "quote_unaligned": F.concat(F.lit("the quote is "), text("aligned.kind"), F.lit(" in the passage: "), text("x.quote")),
        "wrong_attribute": F.concat(F.lit("the measurement is of "), text("x.name"), F.lit(", not of "), c("attribute_name")),
        "value_null": F.lit("the extraction has no value"),
        "value_ungrounded": F.concat(F.lit("the value isn't in the quote: "), text("x.value_text")),
        "unit_ungrounded": F.concat(F.lit("the unit isn't in the quote: "), text("x.unit")),
        "evidence_unit_unsupported": F.concat(F.lit("the document's unit isn't supported: "), text("x.unit")),
        "conversion_error": F.concat(F.lit("the stated value can't be converted: "), F.concat_ws(" ", "x.value_text", "x.unit")),
        "equal": F.concat(F.lit("the document states "), stated, F.lit(" ("), turned, F.lit("), as the record does: "), recorded),
        "differs": F.concat(F.lit("the document states "), stated, F.lit(" ("), turned, F.lit("), the record "), recorded, F.lit("; proposed is "), proposed),
    }
    out = F.lit(None).cast("string")
    for code, why in said.items():
        out = F.when(c("exit_code") == code, why).otherwise(out)
    return out


def metadata() -> Column:
    """What is known of the extractor's call; of one that wasn't made, why."""
    x = F.col("x")
    known = F.struct(
        x["provider"].alias("provider"), x["model"].alias("model"), F.when(x["provider"] == "deterministic", "deterministic").otherwise("model").alias("mode"), x["is_fallback"].alias("is_fallback"),
        x["call_duration_ms"].alias("call_duration_ms"), x["token_usage"].alias("token_usage"), x["token_usage_reason"].alias("token_usage_reason"), x["status"].alias("status"), x["error_type"].alias("error_type"),
    )
    null = F.lit(None).cast("string")
    none = F.struct(
        null.alias("provider"), null.alias("model"), null.alias("mode"), F.lit(False).alias("is_fallback"), F.lit(0.0).alias("call_duration_ms"), F.lit(None).cast("map<string,int>").alias("token_usage"),
        F.concat(F.lit("not called: "), F.col("exit_code")).alias("token_usage_reason"), F.lit("not_invoked").alias("status"), null.alias("error_type"),
    )
    return F.when(x.isNotNull(), known).otherwise(none)


def finish(records: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """The result row, or only some of its columns. Only a correction carries a proposal. A quote that is aligned by white space cites its own span."""
    at = {code: i + 1 for i, (code, _) in enumerate(EXITS)}
    number = F.create_map(*(F.lit(x) for p in at.items() for x in p))[F.col("exit_code")]
    outcome = outcome_of(F.col("exit_code"))
    cited, grounded, tagged = number >= at["extractor_error"], number >= at["evidence_unit_unsupported"], number > at["quote_unaligned"]
    unit, differs = F.lower(rx.strip(F.col("recorded_unit"))), F.col("exit_code") == "differs"
    respaced = tagged & (F.col("aligned.kind") == "whitespace_aligned")
    multiplier = lambda: measure.factor(F.col("x.unit"), F.col("recorded_unit")).cast("double")

    def conversion() -> Column:
        return F.struct(
            F.col("evidence_decimal").cast("double").alias("supplier_extracted_value"), F.lower(rx.strip(F.col("x.unit"))).alias("supplier_extracted_unit"), unit.alias("target_unit"), multiplier().alias("multiplier"),
            measure.calculation(F.col("evidence_decimal"), F.col("x.unit"), F.col("recorded_unit")).alias("calculation"), F.lit("deterministic_arithmetic").alias("method"),
        )

    def nodes() -> Column:
        passed = F.when(number <= at["unit_unsupported"], 1).when(number <= at["no_passage"], 2).when(number <= at["extractor_ambiguous"], 3).when(number <= at["evidence_unit_unsupported"], 4).otherwise(5)
        return F.concat(F.slice(F.array(*map(F.lit, NODES)), F.lit(1), passed), F.array(F.lit("finalize")))

    own = lambda c: lambda: F.col(c)
    when = lambda holds, c: lambda: F.when(holds, F.col(c))
    columns: dict[str, Callable[[], Column]] = {
        **{c: own(c) for c in ("case_id", "record_id", "component_id", "revision", "attribute_name", "recorded_value", "recorded_unit")},
        "outcome": lambda: outcome, "exit_code": own("exit_code"), "exit_number": lambda: number, **{c: own(c) for c in ("retrieval_status", "retrieval_error", "retriever", "reason")},
        "document_filename": when(cited, "document_filename"), "page_number": when(cited, "page_number"), "supporting_passage": lambda: F.when(cited, F.when(respaced, F.col("aligned.span")).otherwise(F.col("passage"))),
        "context_type": when(cited, "context_type"), "similarity_score": when(cited, "similarity"), "model_quote": when(tagged, "x.quote"), "quote_alignment": when(tagged, "aligned.kind"),
        "evidence_value": lambda: F.when(grounded, F.col("evidence_decimal").cast("double")), "evidence_unit": when(grounded, "x.unit"),
        "proposed_value": lambda: F.when(differs, F.col("converted").cast("double")), "proposed_unit": lambda: F.when(differs, unit), "conversion_multiplier": lambda: F.when(differs | (F.col("exit_code") == "equal"), multiplier()),
        "conversion": lambda: F.when(differs, conversion()), "extractor": metadata, "explanation": explanation, "extractor_invoked": lambda: F.col("x").isNotNull(), "node_transitions": nodes,
        "source_record_modified": lambda: F.lit(False), "orchestration": lambda: orchestration(nodes()),
    }
    return records.select(*(columns[c]().alias(c) for c in only or columns))


def orchestration(nodes: Column) -> Column:
    """The graph view of a result: the nodes that its record passed, the tools that were used, and why it ended."""
    used = lambda node: F.array_contains(nodes, node).cast("int")
    tools = F.create_map(F.lit("evidence_retrieval_tool"), used(NODES[1]), F.lit("measurement_extraction_tool"), used(NODES[2]), F.lit("measurement_conversion_tool"), used(NODES[4]))
    return F.struct(
        F.lit("graph").alias("mode"), nodes.alias("node_transitions"), tools.alias("tool_invocations"), F.col("x").isNotNull().cast("int").alias("extractor_invocations"),
        F.when(~F.col("exit_code").isin("equal", "differs"), F.col("exit_code")).alias("terminal_reason"),
    )


def audit(records: DataFrame, pages: DataFrame | None = None, retriever: str | Callable[..., DataFrame] = "baseline", extractor: Callable[[DataFrame], DataFrame] = extract, observe: Callable[[str, DataFrame], DataFrame] = lambda _, df: df, only: tuple[str, ...] | None = None, **sources) -> DataFrame:
    """One row per record. retriever is a name or a function from questions to results; extractor adds struct x to
    questions; observe sees each of the seven stages by name; only names the columns that are made, which saves planning the others."""
    find = retrieve.strategy(retriever) if isinstance(retriever, str) else retriever
    own = observe(STAGES[1], validate(observe(STAGES[0], normalize(records))))
    own, questions = ask(own)
    answers = answer(questions, find, extractor, observe, pages=pages, **sources)
    return finish(observe(STAGES[6], compare(answered(own, answers))), only)


def answered(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Records that have a question id with the answers, or without where there is none."""
    return records.join(grown(answers), "qid", "left").withColumn("exit_code", F.coalesce("exit_code", "answer_code")).drop("answer_code")


class StageCounts:
    """An observe hook: counts the rows of each stage and says when its plan was made; the counts are there once the result has been computed."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.at: dict[str, float] = {}
        self._began = time.perf_counter()

    def __call__(self, stage: str, rows: DataFrame) -> DataFrame:
        self.seen[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        self.at[stage] = round(1000 * (time.perf_counter() - self._began), 3)
        open_ = F.count_if(F.col("exit_code").isNull()) if "exit_code" in rows.columns else F.count(F.lit(1))
        return rows.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"), open_.alias("open"))

    def counts(self) -> list[dict]:
        """One row a stage: its name, milliseconds until it was planned, rows, and rows still open after it."""
        return [{"stage": s, "planned_ms": self.at[s], **o.get} for s, o in self.seen.items()]


class StageTimes:
    """An observe hook that runs the chain stage by stage. Each stage's rows are written to the shared folder, and the next stage begins
    from there, so its seconds are its own, and a lost executor sets back one stage at most. A strategy's search is the stage
    retrieve_evidence, an extractor's calls are in extract_measurement. rows, open and seconds are known when audit() returns."""

    def __init__(self) -> None:
        self.ran: list[dict] = []
        self._ended = time.perf_counter()

    def __call__(self, stage: str, rows: DataFrame) -> DataFrame:
        kept = stored(rows, stage)
        seconds = time.perf_counter() - self._ended
        open_ = F.count_if(F.col("exit_code").isNull()) if "exit_code" in rows.columns else F.count(F.lit(1))
        counted = kept.agg(F.count(F.lit(1)).alias("rows"), open_.alias("open")).first()
        self.ran.append({"stage": stage, "seconds": round(seconds, 3), **counted.asDict()})
        self._ended = time.perf_counter()
        return kept


def chained(records: DataFrame, pages: DataFrame, observe: Callable[[str, DataFrame], DataFrame] = lambda _, df: df, only: tuple[str, ...] | None = None) -> DataFrame:
    """The chain view: the same plan, with rows of each stage counted by observe."""
    return audit(records, pages, observe=observe, only=only)


def violations(requests: DataFrame) -> DataFrame:
    """Adds the names of the request rules that a row breaks (component, attribute, unit, value, extractor, retriever)."""
    empty = lambda *cs: F.coalesce(*(rx.blank(rx.strip(F.col(c))) for c in cs)).isNull()
    rules = {
        "component": empty("component_id", "part_number"), "attribute": empty("attribute_name"), "unit": empty("recorded_unit"),
        "value": measure.decimal(F.col("recorded_value")).isNull(), "extractor": ~F.coalesce("extractor", F.lit("deterministic")).isin("deterministic", "gemini"),
        "retriever": ~F.lower(F.coalesce("retriever", F.lit("baseline"))).isin(*retrieve.ALIASES),
    }
    return requests.withColumn("violations", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull()))


def normalized_request(requests: DataFrame) -> DataFrame:
    """Requests as records: names coalesced, the unit stripped, and of a document reference only what isn't a path of the client's own."""
    own = lambda c: rx.blank(F.col(c).cast("string")) if c in requests.columns else F.lit(None).cast("string")
    component = F.coalesce(own("component_id"), own("part_number"))
    reference = own("document_reference")
    named = F.from_json(reference, "map<string,string>")
    cleaned = F.to_json(F.map_filter(named, lambda k, v: (k != "filepath") & v.isNotNull()))
    return requests.select(
        own("record_id").alias("record_id"), own("case_id").alias("case_id"), component.alias("component_id"), F.coalesce(own("part_number"), component).alias("part_number"), own("revision").alias("revision"),
        F.coalesce(own("attribute_name"), own("attribute"), own("measurement")).alias("attribute_name"), own("recorded_value").alias("recorded_value"), rx.strip(own("recorded_unit")).alias("recorded_unit"),
        F.when(F.startswith(reference, F.lit("{")), cleaned).when(reference.isNotNull(), F.to_json(F.struct(reference.alias("filename")))).alias("document_reference"),
    )


def http_status(kind: Column) -> Column:
    """struct(status_code, error_code) of an error kind, else 200. The codes."""
    known = {"retriever_config": (503, "RETRIEVER_NOT_CONFIGURED"), "database": (502, "RETRIEVER_SERVICE_ERROR"), "model": (502, "RETRIEVER_SERVICE_ERROR"), "extractor_config": (503, "PROVIDER_NOT_CONFIGURED"), "provider": (502, "PROVIDER_REQUEST_FAILED"), "invalid": (422, "INVALID_REQUEST")}
    code, name = F.lit(200), F.lit(None).cast("string")
    for k, (c, n) in known.items():
        code, name = F.when(kind == k, c).otherwise(code), F.when(kind == k, n).otherwise(name)
    return F.struct(code.alias("status_code"), name.alias("error_code"))


