"""Requests in, HTTP answers out, as tables: a server needs only to move bytes. GET /health is HEALTH."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import rx
from attestor.operators import model, retrieve
from attestor.plans import audit as plan

HEALTH = {"status": "healthy"}
#: The extractors that a request may name, and codes of requests that break a rule.
EXTRACTORS = ("deterministic", "gemini")
INVALID = (("extractor", "INVALID_EXTRACTOR"), ("retriever", "INVALID_RETRIEVER"))


def chosen(requests: DataFrame) -> DataFrame:
    """Adds use_extractor and use_retriever: what a request names, lower-cased, or the defaults; other names of a strategy are its own."""
    own = lambda c, d: F.lower(rx.strip(F.coalesce(rx.blank(F.col(c)) if c in requests.columns else F.lit(None).cast("string"), F.lit(d))))
    named = own("retriever", "baseline")
    strategies = F.create_map(*(F.lit(x) for p in retrieve.ALIASES.items() for x in p))
    return requests.withColumns({"use_extractor": own("extractor", "deterministic"), "use_retriever": F.coalesce(strategies[named], named)})


def failure(results: DataFrame) -> Column:
    """The kind of error of a result, as plan.http_status takes it, or null."""
    search, call = F.col("retrieval_error"), F.col("extractor.error_type")
    return (
        F.when(search == "CONFIGURATION_ERROR", "retriever_config").when(search == retrieve.DATABASE_ERROR, "database").when(search == retrieve.MODEL_INCOMPATIBLE, "model")
        .when(call == model.CONFIGURATION_ERROR, "extractor_config").when(call == model.PROVIDER_ERROR, "provider")
    )


def respond(requests: DataFrame, pages: DataFrame, key: str, call: model.Provider | None = None, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """One row a request: its key (unique), status_code, error_code, violations and body (the result as JSON; null for an error).

    call is what the model extractor asks, search the vector strategy over a store; a request that needs one that isn't
    there is answered with 503 or 502, once its evidence has been found.
    """
    fields = [c for c in ("component_id", "part_number", "attribute_name", "recorded_unit", "recorded_value", "extractor", "retriever") if c not in requests.columns]
    asked = chosen(plan.violations(requests.withColumns({c: F.lit(None).cast("string") for c in fields})))
    invalid = F.lit("INVALID_REQUEST")
    for rule, code in reversed(INVALID):
        invalid = F.when(F.array_contains("violations", rule), code).otherwise(invalid)
    null = F.lit(None).cast("string")
    bad = asked.filter(F.size("violations") > 0).select(F.col(key), F.lit(422).alias("status_code"), invalid.alias("error_code"), F.array_join("violations", ",").alias("violations"), null.alias("body"))
    good = asked.filter(F.size("violations") == 0)
    out = bad
    strategies = {"baseline": retrieve.baseline, "vector": search or (lambda questions, **_: retrieve.vector(questions, chunks=None))}
    # Without a provider one plan serves both extractors: what would have been asked of the model is an error.
    extractors = {"deterministic": plan.extract, "gemini": model.by_model(call, provider="gemini")} if call else {"deterministic": plan.extract}
    for s, find in strategies.items():
        for x, extract in extractors.items():
            own = good.filter((F.col("use_retriever") == s) & ((F.col("use_extractor") == x) if call else F.lit(True)))
            named = own.select(F.col(key).cast("string").alias("own_key"), F.col(key), "use_extractor")
            # The key goes through as the case.
            done = plan.audit(plan.normalized_request(own.withColumn("case_id", F.col(key).cast("string"))), pages, retriever=find, extractor=extract)
            done = done.withColumnRenamed("case_id", "own_key").join(named, "own_key")
            unset = (F.col("use_extractor") != "deterministic") & F.col("extractor_invoked") & F.lit(call is None)
            status = plan.http_status(F.when(unset, "extractor_config").otherwise(F.coalesce(failure(done), F.lit("none"))))
            body = F.to_json(F.struct(*(F.col(c) for c in done.columns if c not in ("own_key", key, "use_extractor"))))
            out = out.unionByName(done.select(F.col(key), status["status_code"].alias("status_code"), status["error_code"].alias("error_code"), null.alias("violations"), F.when(status["status_code"] == 200, body).alias("body")))
    return out
