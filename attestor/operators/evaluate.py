"""Evaluation: results against expected answers, rates, latencies, agreement of runs, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import rx
from attestor.operators.evidence import cited_pages
from attestor.sources.shared import grown


def rate(hit: Column, of: Column | None = None, empty: float = 0.0) -> Column:
    """Percent of the rows in of that are hits, to one digit."""
    of = F.lit(True) if of is None else of
    return F.coalesce(F.round(F.lit(100.0) * F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 1), F.lit(empty))


#: Prefixes of case ids by suite, and outcomes with evidence of their own.
SUITES = {"baseline": ("case-",), "challenge": ("challenge-",), "all": ("case-", "challenge-")}
CITING = ("correction_proposed", "no_change")


def suite(rows: DataFrame, name: str, case_id: str = "case_id") -> DataFrame:
    """The cases of a suite, in the order of their ids."""
    if name not in SUITES:
        raise ValueError(f"no suite is named {name!r}")
    belongs = F.lit(False)
    for prefix in SUITES[name]:
        belongs = belongs | F.startswith(F.col(case_id), F.lit(prefix))
    return rows.filter(belongs).orderBy(case_id)


def cases(results: DataFrame, expected: DataFrame, pages: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """results (as of the audit) joined to expected (case_id, expected_outcome, expected_value, expected_unit, expected_file,
    expected_page, expected_passage): outcome, proposal and citation matches, retrieval success, passed, failure_stage.

    A case without an expected answer fails the job, or, if not strict, is left out. With pages a citation is valid only if
    its passage stands on the cited page. results may say api_error and unrun; such cases don't pass, and the stage of an
    error is api. Where a model has extracted, what its guards reject is the stage validation, and what differs extraction.
    """
    of_model = F.col("extractor.mode") == "model" if "extractor" in results.columns else F.lit(False)
    for flag in ("api_error", "unrun"):
        if flag not in results.columns:
            results = results.withColumn(flag, F.lit(False))
    answered = expected.withColumn("answered", F.lit(True))
    r = results.join(grown(answered), "case_id", "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no expected answer for case "), F.coalesce("case_id", F.lit("?")))).cast("string")
        r = r.withColumn("expected_outcome", F.when(F.col("answered"), F.col("expected_outcome")).otherwise(missing))
    r = r.drop("answered")
    if pages is not None:
        r = cited_pages(r, pages)
    outcome = F.col("outcome") == F.col("expected_outcome")
    proposal = F.when(F.col("expected_outcome") == "correction_proposed", F.coalesce((F.col("proposed_value") == F.col("expected_value")) & (F.col("proposed_unit") == F.col("expected_unit")), F.lit(False))).otherwise(F.col("proposed_value").isNull())
    have, want = rx.squeeze(F.col("supporting_passage")), rx.squeeze(F.col("expected_passage"))
    passage = (have == want) | passage_holds(have, want, F.col("context_type"), F.col("quote_alignment"))
    place = (F.col("document_filename") == F.col("expected_file")) & (F.col("page_number") == F.col("expected_page"))
    on_page = F.coalesce("in_page", F.lit(False)) if pages is not None else F.lit(True)
    citation = F.when(F.col("expected_file").isNull(), F.col("document_filename").isNull()).otherwise(F.coalesce(place & passage & on_page, F.lit(False)))
    e = F.col("expected_outcome")
    retrieval = F.coalesce(
        F.when(e.isin(*CITING), (F.col("retrieval_status") == "evidence_found") & F.when(F.col("expected_file").isNull(), True).otherwise(place))
        .when(e.isin("insufficient_evidence", "ambiguous_evidence"), F.col("retrieval_status") == e)
        .otherwise(F.lit(True)),
        F.lit(False),
    )
    ran = ~F.col("api_error") & ~F.col("unrun")
    r = r.withColumns({"outcome_match": outcome, "proposal_match": proposal, "citation_valid": citation, "retrieval_success": retrieval})
    passed = F.coalesce(outcome & proposal & citation & ran, F.lit(False))
    stage = (
        F.when(passed, None)
        .when(F.col("api_error"), "api")
        .when(~retrieval, "retrieval")
        .when(of_model, F.when((F.col("outcome") == "needs_review") | ~citation, "validation").otherwise("extraction"))
        .otherwise(F.when(~outcome | ~proposal, "measurement extraction").otherwise("verification"))
    )
    state = F.when(passed, "passed").when(F.col("unrun"), "unrun").when(F.col("api_error"), "api_error").otherwise("failed")
    return r.withColumns({"passed": passed, "failure_stage": stage, "state": state})


def passage_holds(have: Column, want: Column, context_type: Column, alignment: Column) -> Column:
    """Whether a squeezed passage that isn't the expected one holds it, or lies in it, where that is enough."""
    within = F.contains(have, want) | F.contains(want, have)
    return (context_type.isin("section", "page", "chunk", "expanded_chunk") & within) | ((alignment == "whitespace_aligned") & within)


def summary(rows: DataFrame) -> DataFrame:
    """Counts by state, rates by what was expected, and, where extractors say so, calls of a model and their tokens."""
    e = F.col("expected_outcome")
    out = [
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("passed", "failed", "api_error", "unrun")), rate(F.col("passed")).alias("pass_rate"),
        rate(F.col("passed"), e == "correction_proposed").alias("correction_rate"), rate(F.col("passed"), e == "no_change").alias("agreement_rate"),
        rate(F.col("passed"), ~e.isin(*CITING)).alias("abstention_rate"), rate(F.col("citation_valid"), F.col("expected_file").isNotNull(), 100.0).alias("citation_rate"),
        rate(F.col("retrieval_success"), e.isin(*CITING)).alias("evidence_retrieval_rate"), rate(F.col("retrieval_success"), e.isin("insufficient_evidence", "ambiguous_evidence")).alias("retrieval_abstention_rate"),
        rate(F.col("retrieval_success")).alias("retrieval_rate"),
    ]
    return rows.agg(*out, *(calls(F.col("extractor"), F.col("unrun")) if "extractor" in rows.columns else ()))


def calls(extractor: Column, unrun: Column) -> tuple[Column, ...]:
    """Aggregates of an extractor's metadata: model calls tried, made and not needed, and the tokens of all."""
    tried = (extractor["mode"] == "model") & (extractor["status"] != "not_invoked") & (F.coalesce(extractor["error_type"], F.lit("")) != "CONFIGURATION_ERROR")
    made = tried & extractor["error_type"].isNull()
    tokens = lambda k: F.coalesce(F.sum(F.get(F.array(extractor["token_usage"][k]), F.lit(0))), F.lit(0)).cast("bigint").alias(k)
    no = lambda c: F.coalesce(c, F.lit(False))
    return (F.count_if(no(tried)).alias("calls_tried"), F.count_if(no(made)).alias("calls_made"), F.count_if(~no(tried) & ~unrun).alias("calls_not_needed"), *map(tokens, ("prompt_tokens", "candidates_tokens", "total_tokens")))


def failures(rows: DataFrame, tolerated: tuple[str, ...] = ()) -> DataFrame:
    """The cases that a gate must not let through: failed or broken off by an error, and not among those that are known to fail."""
    return rows.filter(F.col("state").isin("failed", "api_error") & ~F.col("case_id").isin(*tolerated)) if tolerated else rows.filter(F.col("state").isin("failed", "api_error"))


def gate(rows: DataFrame, tolerated: tuple[str, ...] = ()) -> None:
    """Raises if a case fails that isn't known to."""
    bad = [r.case_id for r in failures(rows, tolerated).select("case_id").orderBy("case_id").limit(20).collect()]
    if bad:
        raise AssertionError(f"cases that fail: {', '.join(bad)}")


def comparison(a: DataFrame, b: DataFrame, ranks: DataFrame | None = None, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two runs of the same cases side by side: outcome, proposal, citation, state and stage of each, whether they agree, and
    how b compares to a (improved, worsened, matched). ranks (case_id, first_rank) adds the rank of the right evidence."""
    fields = ("outcome", "proposed_value", "proposed_unit", "citation_valid", "passed", "failure_stage", "retrieval_status")
    side = lambda df, n: df.select("case_id", *(F.col(f).alias(f"{n}_{f}") for f in fields))
    met = side(a, names[0]).join(grown(side(b, names[1])), "case_id")
    agree = F.lit(True)
    for f in fields[:4]:
        agree = agree & F.col(f"{names[0]}_{f}").eqNullSafe(F.col(f"{names[1]}_{f}"))
    before, after = (F.col(f"{n}_passed") for n in names)
    met = met.withColumns({"agreement": agree, "change": F.when(~before & after, "improved").when(before & ~after, "worsened").otherwise("matched")})
    return met if ranks is None else met.join(ranks.select("case_id", "first_rank"), "case_id", "left")


def changes(compared: DataFrame) -> DataFrame:
    """One row: cases, agreements, their rate, and how many improved, matched and worsened."""
    return compared.agg(F.count(F.lit(1)).alias("n"), F.count_if("agreement").alias("n_same"), rate(F.col("agreement")).alias("concordance"), *(F.count_if(F.col("change") == x).alias(x) for x in ("improved", "matched", "worsened")))


def evidence_ranks(ranked: DataFrame, expected: DataFrame, depth: int = 5) -> DataFrame:
    """case_id and first_rank of the chunk that is from the expected file and page and holds the expected passage, but for
    white space; null if none of the first depth does. ranked: query_id (the case), rank, document_filename, page_number, text."""
    gold = expected.filter("expected_file is not null").select(F.col("case_id").alias("query_id"), "expected_file", "expected_page", "expected_passage")
    met = gold.join(ranked.filter(F.col("rank") <= depth), "query_id", "left")
    holds = F.contains(F.col("text"), F.col("expected_passage")) | F.contains(rx.squeeze(F.col("text")), rx.squeeze(F.col("expected_passage")))
    relevant = (F.col("document_filename") == F.col("expected_file")) & (F.col("page_number") == F.col("expected_page")) & holds
    return met.groupBy(F.col("query_id").alias("case_id")).agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


#: Ranges that a value's place is narrowed by at once, and values that are few enough to be looked at one by one.
BINS, FEW = 1024, 4096


def exact_medians(rows: DataFrame, columns: dict[str, Column], bins: int = BINS, few: int = FEW) -> dict[str, float | None]:
    """The exact median of each column, of rows whose value isn't null; null without any. NaN is larger than all else.

    Values are counted in ranges between the least and the greatest, the ranges that hold the middle are kept, and so on, until they
    hold few distinct values; each step reads the rows once, and no task and no driver holds more than bins * few counts.
    """
    values = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()))).alias("x")).select("x.*").filter("v is not null")
    seen = {r.name: r for r in values.groupBy("name").agg(F.count_if(~F.isnan("v")).alias("n"), F.count_if(F.isnan("v")).alias("nans"), F.min(F.nanvl("v", F.lit(None))).alias("low"), F.max(F.nanvl("v", F.lit(None))).alias("high")).collect()}
    found: dict[tuple[str, int], float] = {}
    spans: dict[tuple[str, int], tuple[float, float, int]] = {}  # by column and wanted place: the range that holds it, and how many values lie before it
    for name, r in seen.items():
        for place in {(r.n + r.nans - 1) // 2, (r.n + r.nans) // 2}:
            if place >= r.n:
                found[name, place] = float("nan")
            else:
                spans[name, place] = (r.low, r.high, 0)
    while spans:
        ranges = rows.sparkSession.createDataFrame([(n, k, a, b) for (n, k), (a, b, _) in spans.items()], "name string, place long, low double, high double")
        met = values.join(F.broadcast(ranges), (values["name"] == ranges["name"]) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop(ranges["name"])
        # halves keep the width of a range finite; equal values always share a bin
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        counted = met.groupBy("name", "place", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.approx_count_distinct("v").alias("distinct"))
        wanted: dict[tuple[str, int], list] = {}
        for r in counted.collect():  # bins rows for each wanted place at most
            wanted.setdefault((r.name, r.place), []).append(r)
        left, small = {}, {}
        for at, held in wanted.items():
            before = spans[at][2]
            for r in sorted(held, key=lambda r: r.low):
                if at[1] < before + r.n:
                    if r.low == r.high:
                        found[at] = r.low
                    elif r.distinct <= few // 2 or (r.low, r.high) == spans[at][:2]:
                        small[at] = (r.low, r.high, before)
                    else:
                        left[at] = (r.low, r.high, before)
                    break
                before += r.n
        if small:
            ranges = rows.sparkSession.createDataFrame([(n, k, a, b) for (n, k), (a, b, _) in small.items()], "name string, place long, low double, high double")
            met = values.join(F.broadcast(ranges), (values["name"] == ranges["name"]) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop(ranges["name"])
            per: dict[tuple[str, int], list] = {}
            for r in met.groupBy("name", "place", "v").agg(F.count(F.lit(1)).alias("n")).collect():  # few distinct values for each place
                per.setdefault((r.name, r.place), []).append((r.v, r.n))
            for at, held in per.items():
                before = small[at][2]
                for v, n in sorted(held):
                    before += n
                    if at[1] < before:
                        found[at] = v
                        break
        spans = left
    out: dict[str, float | None] = dict.fromkeys(columns)
    for name, r in seen.items():
        a, b = (found[name, (r.n + r.nans + i) // 2] for i in (-1, 0))
        out[name] = a if a == b else a + (b - a) / 2
    return out


def latency(rows: DataFrame, value: str = "latency_ms", called: str = "model_called", accuracy: int | None = None) -> DataFrame:
    """Median, mean, least and most, over all rows, those with a model call and those without. The median is exact, found by
    a few jobs of bounded memory before this returns; with accuracy it is one of the values, of a rank off by 1 / accuracy at most."""
    kinds = {"all": F.lit(True), "called": F.col(called), "not_called": ~F.col(called)}
    values = {name: F.when(of, F.col(value)) for name, of in kinds.items()}
    exact = exact_medians(rows, values) if accuracy is None else {}
    out = []
    for name, x in values.items():
        median = F.lit(exact[name]).cast("double") if accuracy is None else F.percentile_approx(x, 0.5, accuracy)
        out += [F.round(v, 4).alias(f"{n}_{name}") for n, v in (("median", median), ("mean", F.avg(x)), ("min", F.min(x)), ("max", F.max(x)))]
    return rows.agg(*out)


def concordance(a: DataFrame, b: DataFrame, on: str = "case_id", value: str = "outcome") -> DataFrame:
    met = a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on)
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n_same"), rate(F.col("a").eqNullSafe(F.col("b"))).alias("concordance"))


def first_relevant(ranked: DataFrame, relevant: Column, query: str = "query_id", depth: int = 5) -> DataFrame:
    return ranked.filter(F.col("rank") <= depth).groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


def ir_metrics(firsts: DataFrame) -> DataFrame:
    r = F.col("first_rank")
    return firsts.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_{k}") for k in (1, 2, 3)), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 4).alias("mrr"))


def abort_after_error(rows: DataFrame, error: Column, order: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Marks rows after the first error as unrun. within splits the runs; without it all rows are one.

    The first error of a run is an aggregate, which each row is then held against; no run is sorted or lies in one task. Rows
    with the place of the first error have run; null comes first in order, and null is a run as well.
    """
    place = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    first = F.min(F.when(error, place))
    after = lambda known: F.coalesce(place > known, F.lit(False)).alias("unrun")
    if not within:
        return rows.select("*", after(rows.agg(first).scalar()))
    runs = rows.groupBy(*(F.col(c).alias(f"__run{i}") for i, c in enumerate(within))).agg(first.alias("__first")).filter("__first is not null")
    same = F.lit(True)
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"__run{i}"))
    return rows.join(runs, same, "left").select(*rows.columns, after(F.col("__first")))


def markdown(summary_row: dict, title: str = "Evaluation", compared: list[dict] | None = None) -> str:
    """A report: the summary as a table, and a second one of the cases of a comparison."""
    lines = [f"# {title}", "", "| Metric | Value |", "|---|---:|", *(f"| {k} | {v} |" for k, v in summary_row.items())]
    if compared:
        names = list(compared[0])
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines += ["", "## Cases", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in compared)]
    return "\n".join(lines) + "\n"
