"""Extraction by a model behind a provider: what it is asked, how its answer is checked, and the errors that this can end in.

A provider is a function from a prompt to an Answer; it runs on the workers, batch by batch, and sees nothing but the prompt.
No model is shipped. `offline` makes a provider of a function from (passage, attribute), for tests and dry runs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import measure, rx
from attestor.sources.calls import CallLedger, key

#: The fields of an answer, the states that it may name, and the types of errors.
RESPONSE = "status string, measurement_name string, value string, unit string, quote string"
STATES = ("found", "insufficient", "ambiguous")
CONFIGURATION_ERROR, PROVIDER_ERROR = "CONFIGURATION_ERROR", "PROVIDER_ERROR"
#: What every extractor's result holds.
RESULT = (
    "status string, name string, value_text string, unit string, quote string, error string, error_type string, provider string, model string, "
    "is_fallback boolean, call_duration_ms double, token_usage map<string,int>, token_usage_reason string, raw_response string"
)

_ASK = "\n".join((
    "Find one measurement in the passage below and answer with a JSON object.",
    'Its fields: "status", "measurement_name", "value", "unit", "quote".',
    'If the passage states the measurement once: status "found", the number as a decimal string, the unit as it is written, and the words of the passage that say so, letter by letter.',
    'If it states different values for it: status "ambiguous". If it does not state it: status "insufficient".',
    "Use the passage only. Do not convert units, do not calculate, do not correct anything.",
))
_BEFORE, _BETWEEN, _AFTER = f"{_ASK}\n\nMeasurement: ", '\n\nPassage:\n"""\n', '\n"""\n'


def prompt(passage: Column, attribute: Column) -> Column:
    """Holds the attribute's name and the passage, and nothing of the record."""
    return F.concat(F.lit(_BEFORE), attribute, F.lit(_BETWEEN), passage, F.lit(_AFTER))


def unfenced(text: Column) -> Column:
    """Without a code fence around it."""
    return rx.strip(F.regexp_replace(F.regexp_replace(rx.strip(text), r"^```(?:json)?", ""), r"```$", ""))


def response(text: Column) -> Column:
    """struct(status, measurement_name, value, unit, quote, problem) of an answer's text; problem says why it can't be used."""
    own = unfenced(text)
    parsed = F.from_json(own, RESPONSE)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json(own), f"$.{f}", "variant"))
    names = [f.split()[0] for f in RESPONSE.split(", ")]
    odd = F.filter(F.array(*(F.when(~kind(f).isin("STRING", "VOID"), F.lit(f)) for f in names)), lambda f: f.isNotNull())
    missing = F.filter(F.array(*(F.when(rx.blank(rx.strip(parsed[f])).isNull(), F.lit(f)) for f in names[1:])), lambda f: f.isNotNull())
    problem = (
        F.when(F.try_parse_json(own).isNull() | ~F.startswith(own, F.lit("{")), "the answer isn't a JSON object")
        .when(F.size(odd) > 0, F.concat(F.lit("fields that aren't text: "), F.array_join(odd, ", ")))
        .when(~F.coalesce(parsed["status"].isin(*STATES), F.lit(False)), "the answer has no known status")
        .when((parsed["status"] == "found") & (F.size(missing) > 0), F.concat(F.lit("fields that are missing: "), F.array_join(missing, ", ")))
        .when((parsed["status"] == "found") & ~measure.numeric(parsed["value"]), "the value isn't a decimal")
    )
    return F.struct(*(parsed[f].alias(f) for f in names), problem.alias("problem"))


@dataclass(frozen=True)
class Answer:
    text: str
    prompt_tokens: int | None = None
    candidates_tokens: int | None = None


Provider = Callable[[str], Answer]


def offline(answer: Callable[[str, str], dict | str]) -> Provider:
    """A provider from a function of passage and attribute; words stand for tokens."""

    def call(asked: str) -> Answer:
        attribute, _, rest = asked.removeprefix(_BEFORE).partition(_BETWEEN)
        got = answer(rest.removesuffix(_AFTER), attribute)
        text = got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)
        return Answer(text, len(asked.split()), len(text.split()))

    return call


def attempt(call: Provider, asked: str, timeout: float | None = None, attempts: int = 1) -> dict:
    """What a provider says to a prompt, or how it failed: text, failed, ms, asked, given. A call that takes longer than timeout
    seconds has failed; attempts are all that are made."""
    began, failed, got = time.perf_counter(), None, Answer(None)
    for _ in range(attempts):
        try:
            if timeout is None:
                got, failed = call(asked), None
            else:
                pool = ThreadPoolExecutor(1)
                try:
                    got, failed = pool.submit(call, asked).result(timeout), None
                finally:
                    pool.shutdown(wait=False)
            break
        except Exception as e:  # noqa: BLE001  whatever a provider raises is its error
            failed = f"{type(e).__name__}: {e}"
    return {"text": got.text, "failed": failed, "ms": round(1000 * (time.perf_counter() - began), 2), "asked": got.prompt_tokens, "given": got.candidates_tokens}


def by_model(call: Provider | None, model: str = "none", provider: str = "offline", ledger: CallLedger | None = None, timeout: float | None = None, attempts: int = 1) -> Callable[[DataFrame], DataFrame]:
    """An extractor for the audit: adds struct x (RESULT) to questions with passage and attribute_name. Without a provider every
    question ends in a configuration error, and nothing is called.

    With a ledger the calls are a job of their own when questions come: each prompt that it doesn't know is put to the provider
    once, whatever tasks are run again or branches of the plan share it, and results are read from it. Without one a
    task that is run again calls again.
    """
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("failed", T.StringType()), T.StructField("ms", T.DoubleType()), T.StructField("asked", T.IntegerType()), T.StructField("given", T.IntegerType())])
    ask = partial(attempt, call, timeout=timeout, attempts=attempts)

    @F.pandas_udf(kind)
    def calls(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            frame = pd.DataFrame([ask(p) for p in prompts], columns=kind.names, index=prompts.index)
            yield frame.astype({"asked": "Int32", "given": "Int32"})

    def known(questions: DataFrame) -> DataFrame:
        own = prompt(F.col("passage"), F.col("attribute_name"))
        rows = questions.withColumns({"prompt_key": key(own, f"{provider}/{model}"), "prompt": own})
        ledger.ask(rows.select(F.col("prompt_key").alias("key"), "prompt"), ask, f"{provider}/{model}")
        answers = ledger.answers().select(F.col("key").alias("prompt_key"), F.struct(*kind.names).alias("called"))
        return rows.join(answers, "prompt_key", "left").drop("prompt_key", "prompt")

    def extract(questions: DataFrame) -> DataFrame:
        null = F.lit(None).cast("string")
        if call is None:
            x = result("error", error=F.lit("no provider is configured"), error_type=F.lit(CONFIGURATION_ERROR), provider=F.lit(provider), model=F.lit(model), token_usage_reason=F.lit("not called: no provider is configured"))
            return questions.withColumn("x", x)
        got = known(questions) if ledger else questions.withColumn("called", calls(prompt(F.col("passage"), F.col("attribute_name"))))
        got = got.withColumn("said", response(F.col("called.text")))
        failed, problem, found = F.col("called.failed"), F.col("said.problem"), F.col("said.status") == "found"
        counted = F.col("called.asked").isNotNull() & F.col("called.given").isNotNull()
        usage = F.when(counted, F.create_map(F.lit("prompt_tokens"), F.col("called.asked"), F.lit("candidates_tokens"), F.col("called.given"), F.lit("total_tokens"), F.col("called.asked") + F.col("called.given")))
        x = result(
            F.when(failed.isNotNull() | problem.isNotNull(), "error").otherwise(F.col("said.status")),
            name=F.when(problem.isNull(), F.col("said.measurement_name")), value_text=F.when(found & problem.isNull(), rx.strip(F.col("said.value"))), unit=F.when(found & problem.isNull(), F.lower(rx.strip(F.col("said.unit")))),
            quote=F.when(problem.isNull(), F.when(found, rx.strip(F.col("said.quote"))).otherwise(F.col("said.quote"))), error=F.when(failed.isNotNull(), F.concat(F.lit("the provider failed: "), failed)).when(problem.isNotNull(), F.concat(F.lit("the answer can't be used: "), problem)),
            error_type=F.when(failed.isNotNull() | problem.isNotNull(), PROVIDER_ERROR).otherwise(null), provider=F.lit(provider), model=F.lit(model), call_duration_ms=F.col("called.ms"), token_usage=usage,
            token_usage_reason=F.when(failed.isNotNull(), F.concat(F.lit("the provider failed: "), F.substring_index(failed, ":", 1))).when(~counted, "the provider counted no tokens"), raw_response=F.col("called.text"),
        )
        return got.withColumn("x", x).drop("called", "said")

    extract.eager = ledger is not None  # the audit then hands in a stored table
    return extract


def result(status: Column | str, **fields: Column) -> Column:
    """struct of RESULT; fields that aren't given are null."""
    given = {"status": F.lit(status) if isinstance(status, str) else status, "is_fallback": F.lit(False), **fields}
    return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in RESULT.split(", "))))


def completed(x: Column, names: list[str]) -> Column:
    """An extractor's struct x, which has the fields names, with all fields of RESULT; what built-in expressions find comes from no model."""
    own = {n: x[n] for n in names}
    defaults = {"provider": F.lit("deterministic"), "is_fallback": F.lit(False), "call_duration_ms": F.lit(0.0), "token_usage_reason": F.lit("no model was called")}
    return F.when(x.isNotNull(), F.struct(*(own.get(n, defaults.get(n, F.lit(None))).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in RESULT.split(", ")))))


def extractor(name: str, call: Provider | None = None, **settings: str) -> Callable[[DataFrame], DataFrame] | None:
    """An extractor by its name: "deterministic" is the audit's own (None), "model", "gemini" and "google-genai" ask a provider."""
    known = name.strip().lower()
    if known == "deterministic":
        return None
    if known in ("model", "gemini", "google-genai"):
        return by_model(call, **{"provider": known, **settings})
    raise ValueError(f"no extractor is named {name!r}")
