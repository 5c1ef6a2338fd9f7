"""Retrieval strategies. Each takes distinct questions and gives one row per question, so equal records share the work. What
several joins need is stored in the shared folder first: a table of ids, not of texts.

A question is (qid, component, revision, attribute, stem), and corpus_id where there are many; a result adds retrieval_status, reason, document_filename,
page_number, passage, context_type, similarity and retriever.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import measure, rx
from attestor.sources.shared import grown, stored

FOUND, NONE, SEVERAL, ERROR = "evidence_found", "insufficient_evidence", "ambiguous_evidence", "error"
#: Why a search couldn't be made.
DATABASE_ERROR, MODEL_INCOMPATIBLE = "DATABASE_ERROR", "MODEL_INCOMPATIBLE"
#: Rows of a block of chunks and of a block of queries that meet in one task, and queries of one product of matrices.
CHUNK_BLOCK, QUERY_BLOCK, QUERY_SLICE = 8_000, 2_000, 256
#: Distances that are nearer than this may be equal once they are rounded to 6 places.
TIE = 2e-6
#: Names of the strategies and their other names.
ALIASES = {"baseline": "baseline", "deterministic": "baseline", "regex": "baseline", "pgvector": "vector", "vector": "vector", "postgres": "vector"}


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def corpus_keys(questions: DataFrame, texts: DataFrame) -> list[str]:
    """corpus_id where both sides say it: then a question meets texts of its own corpus and no others."""
    return [c for c in ("corpus_id",) if c in questions.columns and c in texts.columns]


#: Signs that an id without any letter, digit, _ and - begins with.
_RUN, _SIGN = "[a-z0-9_-]+", r"[^a-z0-9_\s-]"


def named(questions: DataFrame, pages: DataFrame, corpus: list[str]) -> DataFrame:
    """Distinct (corpus, source_file, component) whose text may name the component, and plain: whether it then does.

    An id made of letters, digits, _ and - occurs exactly if it is one of a text's runs of these, so texts and ids meet in an
    equi-join on runs. Any other id is sought by that of its runs which the fewest texts have, or its first character if it
    has none. Pages give up their runs where they are, and only runs that are asked for go on.
    """
    ids = questions.select(*corpus, "component").filter("component is not null").distinct()
    runs = F.array_distinct(F.transform(rx.extract_all(F.col("component"), f"{rx.ID}+", 0), F.lower))
    first = F.lower(rx.blank(F.substring(rx.strip(F.col("component")), 1, 1)))
    ids = ids.withColumn("runs", F.when(F.size(runs) > 0, runs).when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")))
    ids = ids.select(*corpus, "component", F.size("runs").alias("n_runs"), F.explode("runs").alias("run"))
    has_sign, has_several = ids.agg(F.bool_or(F.rlike("run", F.lit(f"^{_SIGN}$"))), F.bool_or(F.col("n_runs") > 1)).first()
    text = F.lower("text")
    found = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    if has_sign:
        found = F.concat(found, F.regexp_extract_all(text, F.lit(_SIGN), F.lit(0)))
    held = pages.select(*corpus, "source_file", F.explode(F.array_distinct(found)).alias("run")).join(grown(ids.select(*corpus, "run").distinct()), [*corpus, "run"], "left_semi").distinct()
    sought, several = ids.filter("n_runs = 1").select(*corpus, "component", "run"), ids.filter("n_runs > 1")
    if has_several:
        texts = held.join(grown(several.select(*corpus, "run").distinct()), [*corpus, "run"], "left_semi").groupBy(*corpus, "run").agg(F.count(F.lit(1)).alias("texts"))
        rarest = several.join(grown(texts), [*corpus, "run"]).groupBy(*corpus, "component").agg(F.min_by("run", F.struct("texts", "run")).alias("run"), F.count(F.lit(1)).alias("have"), F.max("n_runs").alias("n_runs"))
        sought = sought.unionByName(rarest.filter("have = n_runs").select(*corpus, "component", "run"))  # a run that no text has rules the id out
    return held.join(grown(sought), [*corpus, "run"]).select(*corpus, "source_file", "component", _plain())


def _plain() -> Column:
    return F.rlike("component", F.lit(f"^{rx.ID}+$")).alias("plain")


def eligible(questions: DataFrame, pages: DataFrame, existing: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(qid, source_file, has_revision) for each text that names a question's component; with corpus_id if both sides have it.
    existing (source_file) says which documents there are, where pages aren't those of all. names (source_file, component) is what
    named() has given for these, where that is known already and there is one corpus.

    If a question refers to a document that exists, only that one counts. What a text says of an id or a revision is looked up once
    for each text and each id or revision that it may name; texts aren't joined to questions.
    """
    corpus = corpus_keys(questions, pages)
    doc = [*corpus, "source_file"]
    questions = stored(questions, "questions")  # else each use of them scans the records again
    stems = (pages if existing is None else existing).select(*corpus, stem(F.col("source_file")).alias("stem")).distinct().withColumn("known", F.lit(True))
    asked = questions.select("qid", *corpus, "component", "revision", "stem").join(grown(stems), [*corpus, "stem"], "left")
    found = named(questions, pages, corpus) if names is None else names.select("source_file", "component", _plain())
    met = found.join(grown(asked), [*corpus, "component"]).filter(F.col("known").isNull() | (stem(F.col("source_file")) == F.col("stem")))
    met = stored(met, "met")  # texts are read for their runs once
    revision = rx.blank(rx.strip(F.col("revision")))
    wanted = met.groupBy(*doc).agg(F.collect_set(F.when(~F.col("plain"), F.col("component"))).alias("ids"), F.collect_set(F.when(revision.isNotNull(), F.col("revision"))).alias("revisions"))
    own = pages.join(grown(wanted.select(*doc)), doc, "left_semi")
    full = own.groupBy(*doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("full"))
    said = wanted.join(grown(full), doc).select(*doc, F.filter("ids", lambda c: rx.matches_component(F.col("full"), c)).alias("ids"), F.filter("revisions", lambda r: rx.matches_revision(F.col("full"), r)).alias("revisions"))
    ids = said.select(*doc, F.explode("ids").alias("component"), F.lit(True).alias("named"))
    revisions = said.select(*doc, F.explode("revisions").alias("revision"), F.lit(True).alias("fits"))
    plain, other = met.filter("plain"), met.filter("not plain").join(grown(ids), [*doc, "component"], "left_semi")
    met = plain.unionByName(other).join(grown(revisions), [*doc, "revision"], "left")
    return met.select("qid", *doc, (revision.isNull() | F.coalesce("fits", F.lit(False))).alias("has_revision"))


def _outcome(per: DataFrame, name: str, error: Column | None = None) -> DataFrame:
    """From the gathered facts of a question to its result. error names what kept the search from being made, or is null."""
    error = F.lit(None).cast("string") if error is None else error
    status = (
        F.when(rx.blank(F.col("component")).isNull() | rx.blank(F.col("attribute")).isNull(), NONE)
        .when(error.isNotNull(), ERROR)
        .when(~F.col("has_component"), NONE)
        .when(~F.col("has_revision"), NONE)
        .when(F.size("facts") > 1, SEVERAL)
        .when(F.col("best").isNull(), NONE)
        .otherwise(FOUND)
    )
    facts = F.array_join(F.transform("facts", lambda f: F.concat_ws(" ", f["value"].cast("string"), f["unit"])), ", ")
    reason = (
        F.when(rx.blank(F.col("component")).isNull(), "the record names no component")
        .when(rx.blank(F.col("attribute")).isNull(), "the record names no attribute")
        .when(error == DATABASE_ERROR, "the chunk table doesn't exist")
        .when(error == MODEL_INCOMPATIBLE, "the query vector has another dimension than the table")
        .when(~F.col("has_component"), F.concat(F.lit("no evidence for component "), "component"))
        .when(~F.col("has_revision"), F.concat(F.lit("no evidence for revision "), F.coalesce("revision", F.lit("?"))))
        .when(F.size("facts") > 1, F.concat(F.lit("conflicting specifications: "), facts))
        .when(F.col("best").isNull(), F.concat(F.lit("no passage states "), "attribute"))
    )
    cite = lambda f: F.when(F.col("retrieval_status") == FOUND, F.col(f"best.{f}")).alias(f)
    per = per.withColumns({"retrieval_status": status, "reason": reason})
    return per.select("qid", "attribute", "retrieval_status", "reason", F.when(F.col("retrieval_status") == ERROR, error).alias("error_type"), *(cite(f) for f in ("document_filename", "page_number", "passage", "context_type", "similarity")), F.lit(name).alias("retriever"))


def baseline(questions: DataFrame, pages: DataFrame, existing: DataFrame | None = None, names: DataFrame | None = None, **_) -> DataFrame:
    """Regular expressions over pages: a direct specification line, else the section or page that mentions the attribute."""
    corpus = corpus_keys(questions, pages)
    doc = [*corpus, "source_file"]
    questions = stored(questions, "questions")  # else each use of them scans the records again
    found = stored(eligible(questions, pages, existing, names).join(grown(questions.select("qid", "attribute")), "qid"), "eligible")
    # What a text says of an attribute is worked out once, whoever asks. Texts of another revision only say that the component is known.
    wanted = found.filter(F.col("has_revision") & rx.blank(F.col("attribute")).isNotNull()).select(*doc, "attribute").distinct()
    at = pages.join(grown(wanted), doc).withColumn("spec", measure.direct_lines(F.col("text"), F.col("attribute")))
    null = F.lit(None).cast("double").alias("similarity")
    line = F.struct(F.col("source_file").alias("document_filename"), "page_number", F.get("spec", F.lit(0))["line"].alias("passage"), F.lit("passage").alias("context_type"), null)
    near = rx.section_or_page(F.col("text"), F.col("attribute"))
    part = F.struct(F.col("source_file").alias("document_filename"), "page_number", near["passage"].alias("passage"), near["context_type"].alias("context_type"), null)
    mentions = F.rlike("text", rx.mention(F.col("attribute")))
    facts = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    said = at.groupBy(*doc, "attribute").agg(
        facts(F.transform("spec", lambda s: F.struct(s["value"].alias("value"), s["unit"].alias("unit")))).alias("facts"),
        F.min_by(F.when(F.size("spec") > 0, line), F.when(F.size("spec") > 0, F.col("page_number"))).alias("direct"),
        F.min_by(F.when(mentions, part), F.when(mentions, F.col("page_number"))).alias("near"),
    )
    fits = found.filter("has_revision").join(grown(said), [*doc, "attribute"], "left").unionByName(found.filter("not has_revision"), allowMissingColumns=True)
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("source_file", F.col(c)["page_number"]))
    per = fits.groupBy("qid").agg(
        F.lit(True).alias("has_component"), F.max("has_revision").alias("has_revision"), facts("facts").alias("facts"),
        F.min_by("direct", place("direct")).alias("direct"), F.min_by("near", place("near")).alias("near"),
    )
    per = questions.join(grown(per), "qid", "left").withColumns({"has_component": F.coalesce("has_component", F.lit(False)), "has_revision": F.coalesce("has_revision", F.lit(False)), "best": F.coalesce("direct", "near")})
    return _outcome(per, "baseline")


#: What a result cites.
BEST = "struct<document_filename:string,page_number:int,passage:string,context_type:string,similarity:double>"


def vector(questions: DataFrame, pages: DataFrame | None = None, chunks: DataFrame | None = None, corpus_id: str = "default", model_name: str = "m", model_revision: str = "1", dimension: int | None = None, **_) -> DataFrame:
    """Exact filtered cosine search over a chunk table. Questions carry query_vector; keys are compared case-sensitively,
    and a missing revision matches nothing. Conflicts are sought in all eligible chunks before any is ranked. Without a
    chunk table, or with a query vector of another dimension, the result is an error. Questions that say a corpus_id search
    that corpus, all corpora in one plan; others search corpus_id."""
    null = F.lit(None)
    if chunks is None:
        none = {"has_component": F.lit(False), "has_revision": F.lit(False), "facts": null.cast("array<struct<value:double,unit:string>>"), "best": null.cast(BEST)}
        return _outcome(questions.withColumns(none), "vector", F.lit(DATABASE_ERROR))
    error = null.cast("string") if dimension is None else F.when(F.coalesce(F.size("query_vector") != dimension, F.lit(True)), MODEL_INCOMPATIBLE)
    if "corpus_id" not in questions.columns:
        chunks = chunks.filter(F.col("corpus_id") == corpus_id).drop("corpus_id")
    corpus = corpus_keys(questions, chunks)
    own = chunks.filter((F.col("model_name") == model_name) & (F.col("model_revision") == model_revision))
    if dimension is not None:
        questions = questions.withColumn("unfit", error).withColumn("query_vector", F.when(F.col("unfit").isNull(), F.col("query_vector")))
        error = F.col("unfit")
    ids = chunks.select(*corpus, F.col("component_id").alias("component")).distinct().withColumn("has_component", F.lit(True))
    met = questions.filter("query_vector is not null").join(grown(own.withColumnRenamed("component_id", "component")), [*corpus, "component", "revision"])
    met = met.select("qid", "attribute", "document_filename", "page_number", "start_char", "chunk_id", "text", measure.cosine_distance(F.col("embedding"), F.col("query_vector")).alias("distance"), measure.direct_lines(F.col("text"), F.col("attribute")).alias("spec"))
    cite = F.struct("document_filename", "page_number", F.col("text").alias("passage"), F.lit("chunk").alias("context_type"), F.round(1 - F.col("distance"), 4).alias("similarity"))
    order = F.struct("distance", "page_number", "start_char", "chunk_id")
    mentions = F.rlike("text", rx.mention(F.col("attribute")))
    per = met.groupBy("qid").agg(
        F.lit(True).alias("has_revision"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("spec", lambda s: F.struct(s["value"].alias("value"), s["unit"].alias("unit"))))))).alias("facts"),
        F.min_by(F.when(F.size("spec") > 0, cite), F.when(F.size("spec") > 0, order)).alias("direct"),
        F.min_by(F.when(mentions, cite), F.when(mentions, order)).alias("near"),
    )
    per = questions.join(grown(ids), [*corpus, "component"], "left").join(grown(per), "qid", "left").withColumns({"has_component": F.coalesce("has_component", F.lit(False)), "has_revision": F.coalesce("has_revision", F.lit(False)), "best": F.coalesce("direct", "near")})
    return _outcome(per, "vector", error)


def ranked(chunks: DataFrame, queries: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("component_id", "revision")) -> DataFrame:
    """Chunks of the same keys by distance, page, offset and id; rank starts at 1."""
    met = queries.join(chunks, list(keys)).withColumn("distance", F.round(measure.cosine_distance(F.col("embedding"), F.col("query_vector")), 6))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "page_number", "start_char", "chunk_id")))
    return met if k is None else met.filter(F.col("rank") <= k)


def closest(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The rows of held (embedding) that can be among the k nearest of a row of asked (query_id, query_vector) once distances
    are rounded to 6 places, ties included; with query_id and distance."""
    out = []
    if len(asked) and len(held):
        # Sums in the order of the vectors' elements, so that distances are those of measure.cosine_distance.
        dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
        a, b = (np.stack(x).astype(np.float64) for x in (asked["query_vector"], held["embedding"]))
        size_a, size_b = np.sqrt(dot(a, a)), np.sqrt(dot(b, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in range(0, len(a), QUERY_SLICE):
                own = slice(at, at + QUERY_SLICE)
                d = 1.0 - (a[own] @ b.T) / (size_a[own, None] * size_b)
                d[np.isnan(d)] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(b) else np.full(len(d), np.inf)
                i, j = np.nonzero(d <= last[:, None] + TIE)
                i += at
                exact = 1.0 - dot(a[i], b[j]) / (size_a[i] * size_b[j])
                out.append(held.drop(columns="embedding").iloc[j].assign(query_id=asked["query_id"].to_numpy()[i], distance=exact))
    return pd.concat(out) if out else held.drop(columns="embedding").iloc[:0].assign(query_id=None, distance=None)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of all chunks, whatever their keys: query_id, chunk_id, distance, rank, ordered as in ranked.

    Each block of queries meets each block of chunks in one task. A block hands on what can be among the first k once
    distances are rounded, ties included. Rows without a vector are left out.
    """
    q = queries.filter("query_vector is not null").select("query_id", "query_vector")
    c = chunks.filter("embedding is not null").select("chunk_id", "page_number", "start_char", "embedding")
    n_q, n_c = max(1, math.ceil(q.count() / query_block)), max(1, math.ceil(c.count() / chunk_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("cb", every(n_c))
    c = c.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(n_c)).cast("int")).withColumn("qb", every(n_q))
    of = lambda df, col: df.schema[col].dataType.simpleString()
    schema = f"query_id {of(q, 'query_id')}, chunk_id {of(c, 'chunk_id')}, page_number {of(c, 'page_number')}, start_char {of(c, 'start_char')}, distance double"

    def block(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = closest(asked, held, k)
        return found[["query_id", "chunk_id", "page_number", "start_char", "distance"]]

    met = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(block, schema).withColumn("distance", F.round("distance", 6))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "page_number", "start_char", "chunk_id")))
    return met.filter(F.col("rank") <= k).select("query_id", "chunk_id", "distance", "rank")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"baseline": baseline, "vector": vector}


def over_store(store, **settings) -> Callable[..., DataFrame]:
    """The vector strategy over a chunk store, whose table is looked for when questions come; without one the result is DATABASE_ERROR."""
    return lambda questions, **sources: vector(questions, chunks=store.read() if store.exists() else None, **settings, **{k: v for k, v in sources.items() if k != "chunks"})


def strategy(name: str) -> Callable[..., DataFrame]:
    if name.lower() not in ALIASES:
        raise ValueError(f"no retriever is named {name!r}")
    return STRATEGIES[ALIASES[name.lower()]]
