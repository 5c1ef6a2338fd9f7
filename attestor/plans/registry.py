"""Queries over the given tables, each with the SQL that says the same.

Datasheets are made of part, records of lineitem; both rules are plain expressions that either engine can run.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import measure, rx
from attestor.operators import chunking, evaluate, evidence, model, report, retrieve
from attestor.plans import audit as plan
from attestor.plans import service
from attestor.plans.incremental import KeptAudit
from attestor.sources import fixtures, npy, readers, store, vector_index
from attestor.sources.calls import CallLedger
from attestor.sources.positions import running
from attestor.sources.shared import folder, grown, shared_dir, stored

# --- derived inputs, in SQL that both engines read ---
_PART = """
SELECT p_partkey AS k, 'P-' || p_partkey AS component, chr(CAST(65 + p_partkey % 3 AS INT)) AS revision, p_size || '.5' AS v1, p_size || '.7' AS v2,
  CASE WHEN p_partkey % 17 = 0 THEN 'in' WHEN p_partkey % 3 = 0 THEN 'cm' ELSE 'mm' END AS unit,
  p_partkey % 11 <> 0 AS stated, p_partkey % 13 = 0 AND p_partkey % 11 <> 0 AS twice, p_partkey % 7 = 0 AS tupled, p_name AS name FROM part
"""
_TEXT = (
    "'Data sheet of the maker' || chr(10) || 'Component ID: ' || component || chr(10) || 'Revision: ' || revision || chr(10) || 'Document ID: DOC-' || k || chr(10) "
    "|| '1. About this part' || chr(10) || 'It is sold as ' || name || '.' || chr(10) || '2. Physical data' || chr(10) "
    "|| CASE WHEN NOT stated THEN '' WHEN tupled THEN 'Envelope (depth, breadth, thickness): 71.25 ' || unit || ' x 33.5 ' || unit || ' x ' || v1 || ' ' || unit || '.' || chr(10) "
    "ELSE 'Nominal thickness: ' || v1 || ' ' || unit || '.' || chr(10) END "
    "|| CASE WHEN twice THEN 'Measured thickness: ' || v2 || ' ' || unit || '.' || chr(10) ELSE '' END || '3. Remarks' || chr(10) || 'This was DOC-' || k || '.'"
)
_SHEETS = f"SELECT 'sheet-' || k || '.pdf' AS source_file, 1 AS page_number, {_TEXT} AS text FROM ({_PART}) p"
_RECORDS = """
SELECT l_orderkey || '-' || l_linenumber AS record_id, CASE WHEN l_orderkey % 50 = 0 THEN 'X-' ELSE 'P-' END || l_partkey AS component_id,
  CASE WHEN l_linenumber = 7 THEN 'Z' ELSE chr(CAST(65 + l_partkey % 3 AS INT)) END AS revision, 'thickness' AS attribute_name,
  CASE WHEN l_suppkey % 97 = 0 THEN 'n/a' ELSE CAST(l_quantity AS INT) || '.5' END AS recorded_value,
  CASE WHEN l_suppkey % 89 = 0 THEN 'kg' WHEN l_orderkey % 2 = 0 THEN 'cm' ELSE 'mm' END AS recorded_unit, l_partkey AS k FROM lineitem
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, sql: str, **tables: str) -> DataFrame:
    return spark.sql(sql, **{k: _table(spark, sf_dir, v) for k, v in tables.items()})


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _SHEETS.replace("FROM part", "FROM {part}"), part="part")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _RECORDS.replace("FROM lineitem", "FROM {lineitem}"), lineitem="lineitem")


#: The outcome by rule, for DuckDB: the facts of a sheet decide, and then the conversion.
_AUDIT_SQL = f"""
WITH p AS ({_PART}), r AS ({_RECORDS}),
f AS (SELECT p.*, stated AND NOT tupled AS line1, CASE WHEN twice AND tupled THEN v2 ELSE v1 END AS v,
  CASE WHEN NOT stated THEN 'none' WHEN twice AND NOT tupled THEN 'several' ELSE 'found' END AS s FROM p),
j AS (SELECT r.*, f.component, f.revision AS own, f.s, f.v, f.unit, try_cast(r.recorded_value AS DECIMAL(28,4)) AS rv, try_cast(f.v AS DECIMAL(28,4)) AS ev
  FROM r LEFT JOIN f ON r.component_id = f.component),
c AS (SELECT *, CASE WHEN unit = recorded_unit THEN ev WHEN unit = 'cm' THEN ev * 10 ELSE ev / 10 END::DECIMAL(28,4) AS cv,
  CASE WHEN rv IS NULL THEN 'value_not_numeric' WHEN recorded_unit NOT IN ('mm', 'cm') THEN 'unit_unsupported'
    WHEN component IS NULL OR own <> revision OR s = 'none' THEN 'insufficient' WHEN s = 'several' THEN 'ambiguous' WHEN unit = 'in' THEN 'evidence_unit_unsupported' END AS early FROM j),
a AS (SELECT record_id, coalesce(early, CASE WHEN rv = cv THEN 'equal' ELSE 'differs' END) AS exit_code, cv, rv, recorded_unit, s, component_id, revision, k FROM c)
"""
_OUTCOME = "CASE exit_code WHEN 'insufficient' THEN 'insufficient_evidence' WHEN 'ambiguous' THEN 'ambiguous_evidence' WHEN 'equal' THEN 'no_change' WHEN 'differs' THEN 'correction_proposed' ELSE 'needs_review' END"

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{_AUDIT_SQL} SELECT record_id, exit_code, {_OUTCOME} AS outcome, CASE WHEN exit_code = 'differs' THEN cv::DOUBLE END AS proposed_value, CASE WHEN exit_code = 'differs' THEN recorded_unit END AS proposed_unit FROM a")
def audit_flagship(spark, sf_dir):
    """The whole audit of all records against all datasheets."""
    return plan.audit(records(spark, sf_dir), sheets(spark, sf_dir), only=("record_id", "exit_code", "outcome", "proposed_value", "proposed_unit"))


@query(f"{_AUDIT_SQL} SELECT {_OUTCOME} AS outcome, count(*) AS n FROM a GROUP BY 1")
def outcome_histogram(spark, sf_dir):
    return plan.audit(records(spark, sf_dir), sheets(spark, sf_dir), only=("outcome",)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_AUDIT_SQL} SELECT CASE WHEN exit_code IN ('value_not_numeric', 'unit_unsupported') THEN 1 WHEN exit_code IN ('insufficient', 'ambiguous') THEN 2 WHEN exit_code = 'evidence_unit_unsupported' THEN 4 ELSE 5 END AS n_nodes, count(*) AS n FROM a GROUP BY 1")
def graph_transitions(spark, sf_dir):
    """How many records pass how many nodes before they are finished."""
    done = plan.audit(records(spark, sf_dir), sheets(spark, sf_dir), only=("node_transitions",))
    return done.groupBy((F.size("node_transitions") - 1).alias("n_nodes")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_AUDIT_SQL}, v AS (SELECT DISTINCT component_id, revision, exit_code FROM a WHERE exit_code NOT IN ('value_not_numeric', 'unit_unsupported')),
q AS (SELECT component_id, revision, bool_or(exit_code = 'evidence_unit_unsupported') AS unfit, bool_or(exit_code NOT IN ('insufficient', 'ambiguous')) AS found FROM v GROUP BY ALL),
n AS (SELECT count(*) AS n, count(*) FILTER (exit_code NOT IN ('value_not_numeric', 'unit_unsupported')) AS open FROM a), m AS (SELECT count(*) AS n, count(*) FILTER (found) AS found, count(*) FILTER (found AND NOT unfit) AS fit FROM q)
SELECT 1 AS nr, 'load_record' AS stage, n AS rows, n AS open, true AS timed FROM n UNION ALL SELECT 2, 'validate_record', n, open, true FROM n UNION ALL SELECT 3, 'retrieve_evidence', n, n, true FROM m UNION ALL SELECT 4, 'judge_retrieval', n, found, true FROM m
UNION ALL SELECT 5, 'extract_measurement', n, found, true FROM m UNION ALL SELECT 6, 'validate_extraction', n, fit, true FROM m UNION ALL SELECT 7, 'compare_measurements', n, 0, true FROM n""")
def stage_times(spark, sf_dir):
    """The chain run stage by stage: rows that come out of each, those still open, and whether its seconds were taken."""
    times = plan.StageTimes()
    plan.chained(records(spark, sf_dir), sheets(spark, sf_dir), times, only=("outcome",))
    rows = [(i + 1, r["stage"], r["rows"], r["open"], r["seconds"] > 0) for i, r in enumerate(times.ran)]  # seven
    return spark.createDataFrame(rows, "nr int, stage string, rows long, open long, timed boolean")


@query(f"{_AUDIT_SQL} SELECT {_OUTCOME} AS outcome, count(*) AS n, count(*) FILTER (exit_code IN ('evidence_unit_unsupported', 'equal', 'differs')) AS n_extracted FROM a GROUP BY 1")
def chain_stages(spark, sf_dir):
    """The seven-stage chain: the same outcomes, and the extractor is asked for open records only."""
    return plan.chained(records(spark, sf_dir), sheets(spark, sf_dir), only=("outcome", "extractor_invoked")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("extractor_invoked").alias("n_extracted"))


@query(f"WITH r AS ({_RECORDS}) SELECT record_id, CASE WHEN try_cast(recorded_value AS DOUBLE) IS NULL THEN 'value_not_numeric' WHEN recorded_unit NOT IN ('mm', 'cm') THEN 'unit_unsupported' END AS exit_code FROM r")
def record_validation(spark, sf_dir):
    return plan.validate(plan.normalize(records(spark, sf_dir))).select("record_id", "exit_code")


@query("SELECT coalesce(nullif(l_returnflag, ''), 'UNKNOWN-CASE') || '' AS case_id, l_orderkey || '' AS record_id, count(*) AS n FROM lineitem GROUP BY ALL")
def record_defaults(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("case_id"), F.col("l_orderkey").cast("string").alias("record_id"))
    return plan.normalize(rows).groupBy("case_id", "record_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS ({_RECORDS}), u AS (SELECT record_id, try_cast(recorded_value AS DECIMAL(28,4)) AS v, recorded_unit AS f FROM r) SELECT record_id, (CASE f WHEN 'mm' THEN v / 10 WHEN 'cm' THEN v END)::DOUBLE AS in_cm, (CASE f WHEN 'cm' THEN v * 10 WHEN 'mm' THEN v END)::DOUBLE AS in_mm FROM u")
def unit_conversion(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("v", measure.decimal(F.col("recorded_value")))
    to = lambda u: measure.converted(F.col("v"), F.col("recorded_unit"), F.lit(u)).cast("double").alias(f"in_{u}")
    return r.select("record_id", to("cm"), to("mm"))


_QUESTIONS = "SELECT DISTINCT component_id, revision FROM r"


def _questions(spark, sf_dir):
    q = records(spark, sf_dir).select(F.col("component_id").alias("component"), "revision", F.col("attribute_name").alias("attribute"), F.lit(None).cast("string").alias("stem")).distinct()
    return q.withColumn("qid", F.concat_ws("/", "component", "revision"))


@query(f"WITH p AS ({_PART}), r AS ({_RECORDS}), q AS ({_QUESTIONS}) SELECT component_id || '/' || q.revision AS qid, 'sheet-' || k || '.pdf' AS source_file, p.revision = q.revision AS has_revision FROM q JOIN p ON p.component = q.component_id")
def component_token_join(spark, sf_dir):
    """Texts that name a component, by an equi-join on runs of id characters."""
    return retrieve.eligible(_questions(spark, sf_dir), sheets(spark, sf_dir))


@query(f"WITH s AS ({_SHEETS}) SELECT source_file, regexp_matches(lower(text), '(^|[^a-z0-9_-])p-1([^a-z0-9_-]|$)') AS names_p1 FROM s")
def component_match(spark, sf_dir):
    return sheets(spark, sf_dir).select("source_file", rx.matches_component(F.col("text"), F.lit("P-1")).alias("names_p1"))


@query(f"WITH s AS ({_SHEETS}) SELECT source_file, regexp_matches(text, 'Revision: B([^A-Za-z0-9_-]|$)') AS is_b, true AS any_revision FROM s")
def revision_match(spark, sf_dir):
    t = F.col("text")
    return sheets(spark, sf_dir).select("source_file", rx.matches_revision(t, F.lit("Rev. B")).alias("is_b"), rx.matches_revision(t, F.lit("")).alias("any_revision"))


@query(f"""WITH p AS ({_PART}), l AS (SELECT 'sheet-' || k || '.pdf' AS source_file, v1 AS v, unit FROM p WHERE stated AND NOT tupled UNION ALL SELECT 'sheet-' || k || '.pdf', v2, unit FROM p WHERE twice)
SELECT source_file, v::DOUBLE AS value, unit FROM l""")
def direct_spec_lines(spark, sf_dir):
    found = sheets(spark, sf_dir).select("source_file", F.explode(measure.direct_lines(F.col("text"), F.lit("thickness"))).alias("f"))
    return found.select("source_file", "f.value", "f.unit")


@query(f"WITH p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS source_file, (stated AND NOT tupled)::INT + twice::INT AS n_facts, twice AND NOT tupled AS conflict FROM p")
def conflict_detection(spark, sf_dir):
    f = F.array_distinct(F.transform(measure.direct_lines(F.col("text"), F.lit("thickness")), lambda x: F.struct(x["value"].alias("v"), x["unit"].alias("u"))))
    return sheets(spark, sf_dir).select("source_file", F.size(f).alias("n_facts"), (F.size(f) > 1).alias("conflict"))


@query(f"WITH s AS (SELECT {_TEXT} AS text, k, stated FROM ({_PART}) p) SELECT 'sheet-' || k || '.pdf' AS source_file, CASE WHEN stated THEN 'section' ELSE 'page' END AS context_type, CASE WHEN stated THEN trim(substr(text, strpos(text, '2. Physical'), strpos(text, '3. Remarks') - strpos(text, '2. Physical')), chr(10)) ELSE text END AS passage FROM s")
def section_extract(spark, sf_dir):
    s = rx.section_or_page(F.col("text"), F.lit("thickness"))
    return sheets(spark, sf_dir).select("source_file", s["context_type"].alias("context_type"), s["passage"].alias("passage"))


@query(f"""{_AUDIT_SQL}, q AS (SELECT DISTINCT component_id, revision FROM a), f2 AS (SELECT component, revision AS own, CASE WHEN NOT stated THEN 'none' WHEN twice AND NOT tupled THEN 'several' ELSE 'found' END AS s FROM p)
SELECT component_id || '/' || q.revision AS qid, CASE WHEN component IS NULL OR own <> q.revision OR s = 'none' THEN 'insufficient_evidence' WHEN s = 'several' THEN 'ambiguous_evidence' ELSE 'evidence_found' END AS retrieval_status,
CASE WHEN component IS NULL THEN 'component' WHEN own <> q.revision THEN 'revision' END AS lacks FROM q LEFT JOIN f2 ON component = component_id""")
def retrieval_diagnosis(spark, sf_dir):
    """Missing components and wrong revisions told apart."""
    found = retrieve.baseline(_questions(spark, sf_dir), sheets(spark, sf_dir))
    return found.select("qid", "retrieval_status", F.when(F.startswith("reason", F.lit("no evidence for c")), "component").when(F.startswith("reason", F.lit("no evidence for r")), "revision").alias("lacks"))


@query(f"WITH p AS ({_PART}), r AS ({_RECORDS}) SELECT component_id, count(*) AS n FROM r WHERE component_id NOT IN (SELECT component FROM p) GROUP BY 1")
def missing_component_anti(spark, sf_dir):
    ids = chunking.identities(sheets(spark, sf_dir)).select("component_id")
    return records(spark, sf_dir).join(ids, "component_id", "left_anti").groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({_PART}) SELECT component || '/' || kind AS qid, CASE WHEN kind = 'known' THEN 'sheet-' || k || '.pdf' WHEN kind = 'other' THEN NULL ELSE 'sheet-' || k || '.pdf' END AS source_file FROM p, (VALUES ('known'), ('unknown'), ('other')) t(kind) WHERE kind <> 'other'")
def doc_ref_prune_fallback(spark, sf_dir):
    """A reference to a document that exists leaves only that, so nothing if it is another component's; one that doesn't leaves all."""
    ids = chunking.identities(sheets(spark, sf_dir)).select(F.col("component_id").alias("component"), retrieve.stem(F.col("source_file")).alias("own"))
    refs = F.array(F.struct(F.lit("known").alias("kind"), F.col("own").alias("stem")), F.struct(F.lit("unknown").alias("kind"), F.lit("nowhere").alias("stem")), F.struct(F.lit("other").alias("kind"), F.when(F.col("own") == "sheet-0", "sheet-1").otherwise("sheet-0").alias("stem")))
    q = ids.select("component", F.explode(refs).alias("r")).select("component", "r.kind", "r.stem", F.lit(None).cast("string").alias("revision"), F.lit("thickness").alias("attribute"))
    q = q.withColumn("qid", F.concat_ws("/", "component", "kind"))
    return retrieve.eligible(q, sheets(spark, sf_dir)).select("qid", "source_file")


@query(f"WITH p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS source_file, component AS component_id, revision, 'DOC-' || k AS document_id, NULL::VARCHAR AS reject_reason FROM p")
def identity_extract(spark, sf_dir):
    return chunking.identities(sheets(spark, sf_dir))


@query(f"WITH p AS ({_PART}) SELECT CASE WHEN k % 4 = 0 THEN 'missing component' WHEN k % 4 = 1 THEN 'missing revision' WHEN k % 4 = 2 THEN 'ambiguous revision' END AS reject_reason, count(*) AS n FROM p GROUP BY 1")
def identity_rejects(spark, sf_dir):
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint") % 4
    t = F.when(k == 0, F.regexp_replace("text", "Component ID", "Item")).when(k == 1, F.regexp_replace("text", "Revision", "Edition")).when(k == 2, F.concat(F.lit("Superseded Revision: Q\n"), "text")).otherwise(F.col("text"))
    found = chunking.identities(sheets(spark, sf_dir).withColumn("text", t))
    return found.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


_CHUNKS_SQL = f"""
WITH s AS (SELECT k, component, revision, {_TEXT} AS text FROM ({_PART}) p),
b AS (SELECT *, unnest([1, strpos(text, chr(10) || '1. About') + 1, strpos(text, chr(10) || '2. Physical') + 1, strpos(text, chr(10) || '3. Remarks') + 1]) AS a, unnest([1, 2, 3, 4]) AS n FROM s),
e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY k ORDER BY n), length(text) + 1) AS z FROM b),
c AS (SELECT k, component, revision, n, a - 1 AS start_char, rtrim(substr(text, a, z - a), chr(10)) AS t FROM e)
"""


@query(f"{_CHUNKS_SQL} SELECT 'sheet-' || k || '_p1_c00' || n AS chunk_id, component AS component_id, revision, start_char::INT AS start_char, (start_char + length(t))::INT AS end_char, (floor(len(string_split_regex(t, '\\s+')) * 1.4::DOUBLE) + 2)::INT AS token_count, sha256(t) AS content_sha256 FROM c")
def chunk_offsets(spark, sf_dir):
    return chunking.chunks(sheets(spark, sf_dir)).select("chunk_id", "component_id", "revision", "start_char", "end_char", "token_count", "content_sha256")


@query(f"{_CHUNKS_SQL} SELECT true AS verbatim, count(*) AS n FROM c")
def chunk_roundtrip(spark, sf_dir):
    pages = sheets(spark, sf_dir)
    return chunking.round_trip(chunking.chunks(pages), pages).groupBy("verbatim").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, (floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.4::DOUBLE) + 2)::INT AS tokens, sha256(text) AS sha FROM documents")
def token_estimate_and_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", measure.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("sha"))


@query(f"WITH p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS source_file, 'ambiguous' AS repeated, 'literal' AS once, 'missing' AS absent, 'whitespace_aligned' AS wrapped, 'About this' || chr(10) || 'part' AS span FROM p")
def quote_alignment(spark, sf_dir):
    """A quote that occurs once, twice, never, and once with other white space."""
    t = F.regexp_replace("text", "About this part", "About this\npart")
    a = lambda q: measure.alignment(F.lit(q), t)
    return sheets(spark, sf_dir).select("source_file", a("DOC-")["kind"].alias("repeated"), a("Data sheet")["kind"].alias("once"), a("no such words")["kind"].alias("absent"), a("About  this part")["kind"].alias("wrapped"), a("About  this part")["span"].alias("span"))


@query(f"WITH p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS source_file, CASE WHEN stated AND tupled THEN v1 END AS thickness, CASE WHEN stated AND tupled THEN '33.5' END AS breadth, CASE WHEN stated AND tupled THEN unit END AS unit FROM p")
def labelled_tuple(spark, sf_dir):
    t = lambda a: measure.labelled_tuple(F.col("text"), F.lit(a))
    return sheets(spark, sf_dir).select("source_file", t("thickness")["value_text"].alias("thickness"), t("breadth")["value_text"].alias("breadth"), t("thickness")["unit"].alias("unit"))


@query(f"WITH p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS source_file, CASE WHEN stated THEN 'found' ELSE 'insufficient' END AS status, CASE WHEN stated THEN v1 END AS value_text, CASE WHEN stated THEN unit END AS unit FROM p")
def measurement_extraction(spark, sf_dir):
    x = measure.extraction(F.regexp_extract("text", r"(?s)(2\. Physical.*)3\. Remarks", 1), F.lit("thickness"))
    # "2. Physical" itself is no measurement of an attribute that isn't stated: its first line has no unit after the number
    return sheets(spark, sf_dir).select("source_file", x["status"].alias("status"), x["value_text"].alias("value_text"), x["unit"].alias("unit"))


def _vectors(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    chunk = v.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("component_id"), F.lit("A").alias("revision"), F.lit(1).alias("page_number"), F.col("vec_id").cast("int").alias("start_char"), "embedding")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("component_id"), F.lit("A").alias("revision"), F.col("embedding").alias("query_vector"))
    return chunk, asked


_RANK_SQL = """
WITH q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, c.vec_id, c.label, q.label AS own, round(1 - list_inner_product(c.embedding::DOUBLE[], q.e::DOUBLE[]) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.e::DOUBLE[], q.e::DOUBLE[]))), 6) AS distance FROM q JOIN embeddings c ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
"""


@query(_RANK_SQL.format(on="c.label = q.label") + "SELECT query_id, vec_id || '' AS chunk_id, rank FROM r WHERE rank <= 5")
def vector_topk_filtered(spark, sf_dir):
    """Exact cosine search among the chunks of the same keys; every 20th vector asks."""
    chunk, asked = _vectors(spark, sf_dir)
    return retrieve.ranked(chunk, asked, 5).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(_RANK_SQL.format(on="true") + "SELECT query_id, vec_id || '' AS chunk_id, rank FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    """Exact cosine search among all chunks; every 20th vector asks."""
    chunk, asked = _vectors(spark, sf_dir)
    return retrieve.nearest(chunk, asked, 5).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(_RANK_SQL.format(on="true") + "SELECT query_id, vec_id || '' AS chunk_id, rank, true AS once FROM r WHERE rank <= 5")
def vector_index_topk(spark, sf_dir):
    """As vector_topk, by an exact search of the index of cells; once: no vector was compared with the query twice."""
    chunk, asked = _vectors(spark, sf_dir)
    n = chunk.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vector_index.over(chunk).search(asked, 5).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), (F.col("compared") <= n).alias("once"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PROFILE_SQL = f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}') AS t FROM documents),
v AS (SELECT doc_id, [{', '.join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in _LETTERS)}] AS e FROM l),
n AS (SELECT doc_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE list_inner_product(e, e) > 0),
d AS (SELECT q.doc_id AS query_id, c.doc_id, round(1 - list_inner_product(c.e, q.e) / (c.size * q.size), 6) AS distance FROM n q JOIN n c ON q.doc_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM d)
"""


def _profiles(spark, sf_dir):
    """Texts as chunks whose vectors count letters, and every 20th as a query."""
    t = F.translate(F.coalesce("text", F.lit("")), _LETTERS.upper(), _LETTERS)
    v = stored(_table(spark, sf_dir, "documents").select("doc_id", F.array(*((F.length(t) - F.length(F.translate(t, c, ""))).cast("float") for c in _LETTERS)).alias("embedding")), "profiles")
    chunk = v.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1).alias("page_number"), F.col("doc_id").alias("start_char"), "embedding")
    return chunk, v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_PROFILE_SQL + "SELECT query_id, doc_id || '' AS chunk_id, rank FROM r WHERE rank <= 5")
def letter_profile_topk(spark, sf_dir):
    """The texts whose letters are spread most alike, by an exact search of the index: here the cells that can't hold one are passed over."""
    chunk, asked = _profiles(spark, sf_dir)
    return vector_index.over(chunk).search(asked, 5).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT 5 * count(*) AS n, true AS enough FROM (" + _PROFILE_SQL + "SELECT DISTINCT query_id FROM r)")
def letter_profile_recall(spark, sf_dir):
    """Whether at least nine of ten of the nearest texts are found by looking into the four nearest cells only."""
    chunk, asked = _profiles(spark, sf_dir)
    index = vector_index.over(chunk)
    met = vector_index.recall(index.search(asked, 5, exact=False), index.search(asked, 5))
    return met.select("n", (F.col("recall") >= 0.9).alias("enough"))


def _others(chunk: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of all chunks but the query's own."""
    met = retrieve.nearest(chunk, asked, k + 1).filter(F.col("chunk_id") != F.col("query_id").cast("string"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


@query(_RANK_SQL.format(on="c.vec_id <> q.query_id") + "SELECT query_id, vec_id || '' AS chunk_id FROM r WHERE rank = 1")
def vector_nearest1_all(spark, sf_dir):
    """The nearest other vector of all, whatever its label."""
    return _others(*_vectors(spark, sf_dir), 1).select("query_id", "chunk_id")


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_dimension, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.001) AS n_norm, 0::BIGINT AS n_not_finite FROM embeddings")
def vector_validation(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("embedding", *(F.lit("x").alias(c) for c in store.REQUIRED))
    return store.violations(v, 64).select("n_rows", "n_dimension", "n_norm", "n_not_finite")


def _by_vector(spark, sf_dir, asked: DataFrame) -> DataFrame:
    chunks = chunking.embed(chunking.chunks(sheets(spark, sf_dir))).withColumns({"model_name": F.lit("m"), "model_revision": F.lit("1")})
    asked = asked.withColumn("ask", F.concat_ws(" ", F.lit("What is the"), "attribute", F.lit("of"), "component"))
    return retrieve.vector(chunking.embed(asked, text_col="ask", out_col="query_vector"), chunks=chunks, dimension=64)


@query(f"""{_AUDIT_SQL}, q AS (SELECT DISTINCT component_id, revision FROM a), f2 AS (SELECT component, revision AS own, CASE WHEN NOT stated THEN 'none' WHEN twice AND NOT tupled THEN 'several' ELSE 'found' END AS s FROM p)
SELECT component_id || '/' || q.revision AS qid, CASE WHEN component IS NULL OR own <> q.revision OR s = 'none' THEN 'insufficient_evidence' WHEN s = 'several' THEN 'ambiguous_evidence' ELSE 'evidence_found' END AS retrieval_status, component IS NOT NULL AS has_component FROM q LEFT JOIN f2 ON component = component_id""")
def conflict_before_topk_all(spark, sf_dir):
    """The vector strategy over chunks of the datasheets, for all questions: conflicts count before ranks."""
    unknown = F.startswith("reason", F.lit("no evidence for component "))
    return _by_vector(spark, sf_dir, _questions(spark, sf_dir)).select("qid", "retrieval_status", (~F.coalesce(unknown, F.lit(False))).alias("has_component"))


@query(_RANK_SQL.format(on="c.vec_id <> q.query_id") + ", f AS (SELECT query_id, min(rank) FILTER (label = own) AS x FROM r WHERE rank <= 5 GROUP BY 1) SELECT count(*) AS n, round(avg((coalesce(x, 99) <= 1)::INT), 4) AS recall_1, round(avg((coalesce(x, 99) <= 2)::INT), 4) AS recall_2, round(avg((coalesce(x, 99) <= 3)::INT), 4) AS recall_3, round(avg(coalesce(1.0 / x, 0)), 4) AS mrr FROM f")
def ir_recall_mrr_all(spark, sf_dir):
    """Recall and mean reciprocal rank of a label among the nearest of all vectors."""
    chunk, asked = _vectors(spark, sf_dir)
    met = _others(chunk, asked, 5).join(chunk.select("chunk_id", "component_id"), "chunk_id").join(asked.select("query_id", F.col("component_id").alias("own")), "query_id")
    return evaluate.ir_metrics(evaluate.first_relevant(met, F.col("component_id") == F.col("own")))


@query("""WITH o AS (SELECT o_orderkey || '' AS chunk_id, 'c' || o_custkey % 5 AS corpus_id, o_orderstatus AS h, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey || '', 'c' || o_custkey % 5, o_orderpriority, 1 FROM orders WHERE o_orderkey % 2 = 0)
SELECT corpus_id, chunk_id, content_sha256 FROM (SELECT corpus_id, chunk_id, h AS content_sha256, row_number() OVER (PARTITION BY corpus_id, chunk_id ORDER BY n DESC, h DESC) AS rn FROM o) WHERE rn = 1""")
def upsert_merge(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("corpus_id"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("created_at"), "o_orderkey")
    old = o.filter("o_orderkey % 3 <> 0").select("chunk_id", "corpus_id", F.col("o_orderstatus").alias("content_sha256"), "created_at")
    new = o.filter("o_orderkey % 2 = 0").select("chunk_id", "corpus_id", F.col("o_orderpriority").alias("content_sha256"), "created_at")
    return store.upserted(old, new).select("corpus_id", "chunk_id", "content_sha256")


@query("SELECT round(median(value), 4) AS median_all, round(avg(value), 4) AS mean_all, min(value) AS min_all, max(value) AS max_all, round(median(value) FILTER (event_type = 'click'), 4) AS median_called, round(avg(value) FILTER (event_type = 'click'), 4) AS mean_called, min(value) FILTER (event_type = 'click') AS min_called, max(value) FILTER (event_type = 'click') AS max_called, round(median(value) FILTER (event_type <> 'click'), 4) AS median_not_called, round(avg(value) FILTER (event_type <> 'click'), 4) AS mean_not_called, min(value) FILTER (event_type <> 'click') AS min_not_called, max(value) FILTER (event_type <> 'click') AS max_not_called FROM (SELECT round(value, 4) AS value, event_type FROM events)")
def eval_latency_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.round("value", 4).alias("latency_ms"), (F.col("event_type") == "click").alias("model_called"))
    return evaluate.latency(rows)


@query("WITH a AS (SELECT event_id, event_type AS x, CASE WHEN event_id % 10 = 0 THEN 'other' ELSE event_type END AS y FROM events) SELECT count(*) AS n, count(*) FILTER (x = y) AS n_same, round(100.0 * count(*) FILTER (x = y) / count(*), 1)::DOUBLE AS concordance FROM a")
def concordance(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("outcome"))
    return evaluate.concordance(a, a.withColumn("outcome", F.when(F.col("case_id") % 10 == 0, "other").otherwise(F.col("outcome"))))


@query("SELECT event_id, coalesce(max(value > 99) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS unrun FROM events")
def abort_after_error(spark, sf_dir):
    return evaluate.abort_after_error(_table(spark, sf_dir, "events"), F.col("value") > 99, ("ts", "event_id"), ("user_id",)).select("event_id", "unrun")


@query("SELECT event_id, coalesce(max(value > 99) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS unrun FROM events")
def abort_after_first_error(spark, sf_dir):
    """All events as one run."""
    return evaluate.abort_after_error(_table(spark, sf_dir, "events"), F.col("value") > 99, ("ts", "event_id")).select("event_id", "unrun")


@query(f"""WITH s AS (SELECT k, {_TEXT} AS text FROM ({_PART}) p), e AS (SELECT CASE WHEN k % 17 = 0 THEN 'not JSON' WHEN k % 19 = 0 THEN 'not an object' WHEN k % 23 = 0 THEN 'no source_file' WHEN k % 29 = 0 THEN 'no pages' END AS error, text FROM s)
SELECT coalesce(error, 'page') AS kind, count(*) AS n, CASE WHEN error IS NULL THEN sum(length(text)) END::BIGINT AS chars FROM e GROUP BY error""")
def page_files(spark, sf_dir):
    """Sheets written as JSON lines, some of them broken, and read back: pages, and what is wrong with each line that isn't one."""
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    pages = F.when(k % 29 != 0, F.array(F.struct("page_number", "text")))
    line = F.to_json(F.struct(F.when((k % 23 != 0) | (k % 17 == 0) | (k % 19 == 0), F.col("source_file")).alias("source_file"), pages.alias("pages")))
    text = F.when(k % 17 == 0, F.substring(line, 1, 20)).when(k % 19 == 0, F.to_json(F.array("source_file"))).when(k % 5 == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    path = folder(spark, "pages")
    sheets(spark, sf_dir).select(text.alias("value")).write.text(path)
    good, bad = readers.pages_and_errors(spark, path)
    kinds = good.select(F.lit("page").alias("kind"), F.length("text").alias("chars")).unionByName(bad.select(F.col("error").alias("kind"), F.lit(None).cast("int").alias("chars")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def whitespace_norm(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", rx.squeeze(F.col("text")).alias("flat"))


@query("SELECT page_id, 'failed: password=*** at [path] for ' || page_id AS message FROM pages")
def sanitize_error(spark, sf_dir):
    raw = F.concat(F.lit("failed: password = s3cret"), F.col("page_id").cast("string"), F.lit(" at /srv/data/x.json for "), F.col("page_id").cast("string"))
    return _table(spark, sf_dir, "pages").select("page_id", measure.sanitize(raw).alias("message"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 502 WHEN 2 THEN 502 WHEN 3 THEN 422 ELSE 200 END AS status_code, CASE event_id % 5 WHEN 0 THEN 'RETRIEVER_NOT_CONFIGURED' WHEN 1 THEN 'RETRIEVER_SERVICE_ERROR' WHEN 2 THEN 'PROVIDER_REQUEST_FAILED' WHEN 3 THEN 'INVALID_REQUEST' END AS error_code FROM events")
def http_status_map(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("retriever_config", "database", "provider", "invalid", "none"))), (F.col("event_id") % 5).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", plan.http_status(kind).alias("s")).select("event_id", "s.*")


@query(f"WITH r AS ({_RECORDS}) SELECT record_id, CASE WHEN try_cast(recorded_value AS DOUBLE) IS NULL THEN 'value' ELSE '' END AS broken FROM r")
def request_validation(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("part_number", "extractor", "retriever")})
    return plan.violations(r).select("record_id", F.array_join("violations", ",").alias("broken"))


@query(f"""{_AUDIT_SQL.replace("'P-' || p_partkey AS component", "'P-' || p_partkey AS component, p_partkey % 10 = 3 AS renewed").replace("p_size || '.5' AS v1", "CASE WHEN p_partkey % 10 = 3 THEN '88.5' ELSE p_size || '.5' END AS v1")},
d AS (SELECT DISTINCT component_id, revision, k, exit_code, recorded_unit, rv FROM a), u AS (SELECT count(DISTINCT component_id) AS t FROM d JOIN p ON component = component_id WHERE renewed)
SELECT {_OUTCOME} AS outcome, count(*) AS n, true AS a_part FROM (SELECT DISTINCT record_id, exit_code FROM a) GROUP BY 1""")
def kept_audit(spark, sf_dir):
    """An audit that is kept up when every tenth sheet states another thickness: outcomes by record, and whether an eighth of the
    distinct records at most were audited anew, with an eighth of the sheets."""
    kept, pages = KeptAudit(spark, folder(spark, "kept")), sheets(spark, sf_dir)
    own = records(spark, sf_dir).select("record_id", "component_id", "revision", "attribute_name", "recorded_value", "recorded_unit")
    first = kept.refresh(own, pages)
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    size = r"(Nominal thickness: |33\.5 [a-z]+ x )[0-9.]+"
    second = kept.refresh(own, pages.withColumn("text", F.when(k % 10 == 3, F.regexp_replace("text", size, "$188.5")).otherwise(F.col("text"))))
    part = 8 * second.audited <= first.audited and 8 * second.searched <= first.searched
    met = second.of(own, only=("record_id", "exit_code")).distinct()
    return met.groupBy(plan.outcome_of(F.col("exit_code")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).withColumn("a_part", F.lit(part))


# --- every exit of the audit, each of them planted ---
#: By k % 20: the exit that a part's record is to take, and its outcome.
_EXITS = "VALUES " + ", ".join(f"({i}, '{code}', '{outcome}')" for i, (code, outcome) in enumerate(plan.EXITS))
_PLANTED = "SELECT p_partkey AS k, p_partkey % 20 AS s, 'Q-' || (p_partkey % 20) || '-' || p_partkey AS component_id, (p_partkey % 50) || '.5' AS v, (p_partkey % 50) * 10 + 5 AS ten FROM part"
_AT = {code: i for i, (code, _) in enumerate(plan.EXITS)}


def _scenario(component: Column) -> Column:
    return F.split(component, "-")[1].cast("int")


def _planted(spark, sf_dir):
    """Records of all scenarios, the retriever and the extractor that lead each to its exit."""
    k = F.col("p_partkey")
    s = k % 20
    is_ = lambda code: s == _AT[code]
    text = lambda n: n.cast("string")
    value = F.when(is_("value_missing"), None).when(is_("value_not_numeric"), "n/a").when(is_("value_out_of_range"), "0.12345678901234567").when(is_("equal"), text(k % 50 * 10 + 5)).otherwise(F.lit("0.25"))
    rows = _table(spark, sf_dir, "part").select(
        text(k).alias("record_id"), F.concat_ws("-", F.lit("Q"), text(s), text(k)).alias("component_id"), F.lit("A").alias("revision"), F.lit("depth").alias("attribute_name"),
        value.alias("recorded_value"), F.when(is_("unit_unsupported"), "kg").otherwise("mm").alias("recorded_unit"),
    )

    def find(questions, **_):
        s, n = _scenario(F.col("component")), F.split("component", "-")[2].cast("bigint")
        at = lambda code: s == _AT[code]
        status = F.when(at("retrieval_error"), retrieve.ERROR).when(at("insufficient"), retrieve.NONE).when(at("ambiguous"), retrieve.SEVERAL).otherwise(retrieve.FOUND)
        unit = F.when(at("evidence_unit_unsupported"), "in").otherwise("cm")
        passage = F.concat(F.lit("The depth was\nmeasured as "), F.when(at("conversion_error"), "1234567890123456789.5").otherwise(F.concat(text(n % 50), F.lit(".5"))), F.lit(" "), unit, F.lit(" by hand."))
        return questions.select(
            "qid", "component", "attribute", status.alias("retrieval_status"), F.when(at("retrieval_error"), "the table is locked").when(at("insufficient"), "nothing").when(at("ambiguous"), "two of them").alias("reason"),
            F.when(at("retrieval_error"), retrieve.DATABASE_ERROR).alias("error_type"), F.concat(F.lit("f"), text(n), F.lit(".pdf")).alias("document_filename"), F.lit(1).alias("page_number"),
            F.when(~at("no_passage"), passage).alias("passage"), F.lit("section").alias("context_type"), F.lit(None).cast("double").alias("similarity"), F.lit("planted").alias("retriever"),
        )

    def extract(questions):
        s, n = _scenario(F.col("component")), F.split("component", "-")[2].cast("bigint")
        at = lambda code: s == _AT[code]
        own = F.when(at("conversion_error"), "1234567890123456789.5").when(at("value_ungrounded"), "999.75").when(at("value_null"), None).otherwise(F.concat(text(n % 50), F.lit(".5")))
        unit = F.when(at("unit_ungrounded"), "mm").when(at("evidence_unit_unsupported"), "in").otherwise("cm")
        quote = F.when(at("quote_unaligned"), "no such words").when(at("differs"), F.regexp_replace(F.regexp_extract("passage", r"(?s)^(.*) by hand", 1), "\n", " ")).otherwise(F.regexp_extract("passage", r"measured as (.*) by hand", 1))
        x = model.result(
            F.when(at("extractor_error"), "error").when(at("extractor_insufficient"), "insufficient").when(at("extractor_ambiguous"), "ambiguous").otherwise("found"), name=F.when(at("wrong_attribute"), "breadth").otherwise("depth"), value_text=own, unit=unit,
            quote=quote, error=F.when(at("extractor_error"), "no answer"), error_type=F.when(at("extractor_error"), model.PROVIDER_ERROR), provider=F.lit("planted"), model=F.lit("m1"), token_usage=F.when(~at("extractor_error"), F.create_map(F.lit("total_tokens"), F.lit(7))),
        )
        return questions.withColumn("x", x)

    return rows, find, extract


def _exits(spark, sf_dir):
    rows, find, extract = _planted(spark, sf_dir)
    return plan.audit(rows, None, retriever=find, extractor=extract)


@query(f"WITH p AS ({_PLANTED}), e(s, exit_code, outcome) AS ({_EXITS}) SELECT k || '' AS record_id, exit_code, outcome, (p.s + 1)::INT AS exit_number, p.s >= 8 AS extractor_invoked FROM p JOIN e USING (s)")
def audit_exits(spark, sf_dir):
    """Records that take every exit of the audit, by a planted retriever and extractor."""
    return _exits(spark, sf_dir).select("record_id", "exit_code", "outcome", "exit_number", "extractor_invoked")


@query(f"""WITH p AS ({_PLANTED}) SELECT k || '' AS record_id,
CASE s WHEN 0 THEN 'the record has no value' WHEN 1 THEN 'the recorded value isn''t a number: n/a' WHEN 4 THEN 'the search failed: the table is locked' WHEN 8 THEN 'the extraction failed: no answer' WHEN 12 THEN 'the measurement is of breadth, not of depth'
  WHEN 18 THEN 'the document states ' || v || ' cm (' || v || ' cm x 10 = ' || ten || ' mm), as the record does: ' || ten || ' mm' WHEN 19 THEN 'the document states ' || v || ' cm (' || v || ' cm x 10 = ' || ten || ' mm), the record 0.25 mm; proposed is ' || ten || ' mm' END AS explanation,
CASE WHEN s = 19 THEN v::DOUBLE END AS stated, CASE WHEN s = 19 THEN 10.0::DOUBLE END AS multiplier, CASE WHEN s = 19 THEN v || ' cm x 10 = ' || ten || ' mm' END AS calculation, CASE WHEN s = 19 THEN ten::DOUBLE END AS proposed_value,
CASE WHEN s = 19 THEN 'The depth was' || chr(10) || 'measured as ' || v || ' cm' WHEN s >= 8 THEN 'The depth was' || chr(10) || 'measured as ' || CASE WHEN s = 17 THEN '1234567890123456789.5' ELSE v END || CASE WHEN s = 16 THEN ' in' ELSE ' cm' END || ' by hand.' END AS supporting_passage,
CASE WHEN s = 19 THEN 'whitespace_aligned' WHEN s >= 12 THEN 'literal' END AS quote_alignment FROM p""")
def result_contract(spark, sf_dir):
    """Explanations, the conversion of a correction, and citations: a quote that is aligned by white space cites its own span."""
    shown = F.col("exit_code").isin("value_missing", "value_not_numeric", "retrieval_error", "extractor_error", "wrong_attribute", "equal", "differs")
    return _exits(spark, sf_dir).select(
        "record_id", F.when(shown, F.col("explanation")).alias("explanation"), F.col("conversion.supplier_extracted_value").alias("stated"), "conversion.multiplier", "conversion.calculation",
        "proposed_value", "supporting_passage", "quote_alignment",
    )


@query(f"""WITH p AS ({_PLANTED}), x AS (SELECT s >= 8 AS called, s = 8 AS failed FROM p)
SELECT count(*) FILTER (called) AS calls_tried, count(*) FILTER (called AND NOT failed) AS calls_made, count(*) FILTER (NOT called) AS calls_not_needed, 0::BIGINT AS prompt_tokens, 0::BIGINT AS candidates_tokens, (7 * count(*) FILTER (called AND NOT failed))::BIGINT AS total_tokens FROM x""")
def model_calls(spark, sf_dir):
    """Calls of a model that were tried, made and not needed, and their tokens."""
    return _exits(spark, sf_dir).agg(*evaluate.calls(F.col("extractor"), F.lit(False)))


@query(f"""WITH p AS ({_PLANTED}) SELECT k || '' AS record_id, s >= 8 AS has_document, CASE WHEN s >= 8 THEN 'f' || k || '.pdf' END AS file, CASE WHEN s >= 8 THEN 'section' END AS context_type, CASE WHEN s >= 8 THEN 'default' END AS corpus_id,
CASE WHEN s >= 8 THEN component_id END AS component, 'Component ' || component_id || ' depth physical dimension parameter specification' AS query, CASE WHEN s = 19 THEN 'The depth' WHEN s >= 8 THEN 'The depth' END AS preview FROM p""")
def evidence_documents(spark, sf_dir):
    """The cited passage as a document with its metadata, the text of the search, and a preview."""
    d = evidence.documents(_exits(spark, sf_dir))
    m = F.col("evidence_document.metadata")
    return d.select("record_id", F.col("evidence_document").isNotNull().alias("has_document"), m["document_filename"].alias("file"), m["context_type"].alias("context_type"), m["corpus_id"].alias("corpus_id"), m["component_id"].alias("component"), evidence.query_text(F.col("component_id"), F.col("attribute_name")).alias("query"), evidence.preview(F.col("supporting_passage"), 9).alias("preview"))


def _told(passage: str, attribute: str) -> dict | str:
    """A stand-in for a model, which reads the last number with a unit."""
    found = re.findall(rf"((?:{attribute}: |[a-z]+ x [0-9.]+ [a-z]+ x )([0-9.]+) ([a-z]+))\.", passage)
    return {"status": "insufficient"} if not found else {"status": "found", "measurement_name": attribute, "value": found[-1][1], "unit": found[-1][2], "quote": found[-1][0]}


@query(f"""{_AUDIT_SQL}, d AS (SELECT component AS c, CASE WHEN twice AND tupled THEN 'line' WHEN tupled THEN 'section' ELSE 'nominal' END AS kind FROM p),
n AS (SELECT count(DISTINCT kind || ' ' || f.v || ' ' || f.unit) AS calls FROM a JOIN d ON c = component_id JOIN f ON f.component = component_id WHERE exit_code IN ('equal', 'differs', 'evidence_unit_unsupported'))
SELECT {_OUTCOME} AS outcome, count(*) AS n, any_value(calls) AS calls FROM a, n GROUP BY 1""")
def model_ledger(spark, sf_dir):
    """Two audits by a model that share a ledger of calls: outcomes of the second, and how many calls were made in all."""
    ledger = CallLedger(spark, folder(spark, "calls"))
    for _ in range(2):
        done = plan.audit(records(spark, sf_dir), sheets(spark, sf_dir), extractor=model.by_model(model.offline(_told), ledger=ledger), only=("outcome",))
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("calls", F.lit(ledger.read().count()))


# --- evaluation against answers that SQL derives, with planted disagreements ---
_JUDGED = f"""{_AUDIT_SQL},
b AS (SELECT DISTINCT record_id, k, rv, recorded_unit, exit_code, {_OUTCOME} AS outcome, CASE k % 7 WHEN 0 THEN 'outcome' WHEN 1 THEN 'value' WHEN 2 THEN 'file' WHEN 3 THEN 'passage' WHEN 4 THEN 'api' WHEN 5 THEN 'unrun' ELSE 'none' END AS bad FROM a),
m AS (SELECT *, exit_code IN ('equal', 'differs') AS citing, exit_code IN ('insufficient', 'ambiguous') AS abstained FROM b)
"""


def _judged(spark, sf_dir):
    """Results, and expected answers derived from the part and the record alone; by k % 7 an answer is wrong, or the run is."""
    own = records(spark, sf_dir).distinct().withColumn("case_id", F.concat_ws("/", "record_id", F.col("k").cast("string"), "recorded_value", "recorded_unit"))
    bad = F.element_at(F.array(*map(F.lit, ("outcome", "value", "file", "passage", "api", "unrun", "none"))), (F.col("k") % 7 + 1).cast("int"))
    facts = _sql(spark, sf_dir, f"SELECT k AS fk, component, revision AS own, v1, v2, unit, stated, twice, tupled FROM ({_PART.replace('FROM part', 'FROM {part}')}) p", part="part")
    met = own.join(facts, F.col("component_id") == F.col("component"), "left")
    rv, number = F.col("recorded_value").try_cast("decimal(20,4)"), lambda c: F.col(c).try_cast("decimal(20,4)")
    ev = F.when(F.col("twice") & F.col("tupled"), number("v2")).otherwise(number("v1"))
    cv = F.when(F.col("unit") == F.col("recorded_unit"), ev).when(F.col("unit") == "cm", ev * 10).otherwise(ev / 10).cast("decimal(20,5)")
    code = (
        F.when(rv.isNull(), "needs_review").when(~F.col("recorded_unit").isin("mm", "cm"), "needs_review")
        .when(F.col("component").isNull() | (F.col("own") != F.col("revision")) | ~F.col("stated"), "insufficient_evidence").when(F.col("twice") & ~F.col("tupled"), "ambiguous_evidence")
        .when(F.col("unit") == "in", "needs_review").when(rv == cv, "no_change").otherwise("correction_proposed")
    )
    met = met.withColumns({"code": code, "bad": bad, "cv": cv})
    line = F.when(F.col("twice") & F.col("tupled"), F.concat(F.lit("Measured thickness: "), "v2", F.lit(" "), "unit", F.lit("."))).when(F.col("tupled"), F.concat(F.lit("Envelope (depth, breadth, thickness): 71.25 "), "unit")).otherwise(F.concat(F.lit("Nominal thickness: "), "v1", F.lit(" "), "unit", F.lit(".")))
    cites = F.col("code").isin("no_change", "correction_proposed") | ((F.col("code") == "needs_review") & (F.col("unit") == "in") & rv.isNotNull() & F.col("recorded_unit").isin("mm", "cm") & (F.col("own") == F.col("revision")) & F.col("stated") & ~(F.col("twice") & ~F.col("tupled")))
    want = met.select(
        "case_id", F.when((F.col("bad") == "outcome") & (F.col("code") == "no_change"), "needs_review").otherwise(F.col("code")).alias("expected_outcome"),
        F.when(F.col("code") == "correction_proposed", F.col("cv").cast("double") + F.when(F.col("bad") == "value", 1.0).otherwise(0.0)).alias("expected_value"), F.when(F.col("code") == "correction_proposed", F.col("recorded_unit")).alias("expected_unit"),
        F.when(cites, F.when((F.col("bad") == "file") & F.col("code").isin("no_change", "correction_proposed"), "another.pdf").otherwise(F.concat(F.lit("sheet-"), F.col("fk").cast("string"), F.lit(".pdf")))).alias("expected_file"), F.when(cites, 1).alias("expected_page"),
        F.when(cites, F.when((F.col("bad") == "passage") & F.col("code").isin("no_change", "correction_proposed"), "words of no page").otherwise(line)).alias("expected_passage"),
    )
    done = plan.audit(own.select("case_id", "record_id", "component_id", "revision", "attribute_name", "recorded_value", "recorded_unit"), sheets(spark, sf_dir))
    flags = own.select("case_id", (bad == "api").alias("api_error"), (bad == "unrun").alias("unrun"))
    return evaluate.cases(done.join(flags, "case_id"), want, sheets(spark, sf_dir))


_FAILED = "(bad = 'api' OR bad = 'unrun' OR (bad = 'outcome' AND exit_code = 'equal') OR (bad = 'value' AND exit_code = 'differs') OR (bad IN ('file', 'passage') AND citing))"
_PCT = lambda hit, of: f"coalesce(round(100.0 * count(*) FILTER ({hit} AND {of}) / nullif(count(*) FILTER ({of}), 0), 1), 0)::DOUBLE"
#: What is expected after planting: an answer that is to be no_change but says needs_review counts there.
_EXPECTED = "CASE WHEN bad = 'outcome' AND exit_code = 'equal' THEN 'needs_review' ELSE outcome END"


@query(f"""{_JUDGED} SELECT count(*) AS n, count(*) FILTER (NOT {_FAILED}) AS n_passed, count(*) FILTER ({_FAILED} AND bad NOT IN ('api', 'unrun')) AS n_failed, count(*) FILTER (bad = 'api') AS n_api_error, count(*) FILTER (bad = 'unrun') AS n_unrun,
{_PCT(f'NOT {_FAILED}', 'true')} AS pass_rate, {_PCT(f'NOT {_FAILED}', f"{_EXPECTED} = 'correction_proposed'")} AS correction_rate, {_PCT(f'NOT {_FAILED}', f"{_EXPECTED} = 'no_change'")} AS agreement_rate,
{_PCT(f'NOT {_FAILED}', f"{_EXPECTED} NOT IN ('no_change', 'correction_proposed')")} AS abstention_rate, {_PCT("NOT (citing AND bad IN ('file', 'passage'))", "(citing OR exit_code = 'evidence_unit_unsupported')")} AS citation_rate,
{_PCT("bad <> 'file'", f"{_EXPECTED} IN ('no_change', 'correction_proposed')")} AS evidence_retrieval_rate, {_PCT('true', 'abstained')} AS retrieval_abstention_rate, {_PCT("NOT (citing AND bad = 'file')", 'true')} AS retrieval_rate FROM m""")
def evaluation_report(spark, sf_dir):
    """Counts and rates against independent answers, some of them wrong on purpose."""
    return evaluate.summary(_judged(spark, sf_dir)).drop("calls_tried", "calls_made", "calls_not_needed", "prompt_tokens", "candidates_tokens", "total_tokens")


@query(f"""{_JUDGED} SELECT CASE WHEN NOT {_FAILED} THEN NULL WHEN bad = 'api' THEN 'api' WHEN bad = 'file' THEN 'retrieval' WHEN bad IN ('outcome', 'value') THEN 'measurement extraction' ELSE 'verification' END AS failure_stage, count(*) AS n FROM m GROUP BY 1""")
def failure_stages(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("failure_stage").agg(F.count(F.lit(1)).alias("n"))


_STAGE_SQL = f"CASE WHEN NOT {_FAILED} THEN NULL WHEN bad = 'api' THEN 'api' WHEN bad = 'file' THEN 'retrieval' WHEN bad IN ('outcome', 'value') THEN 'measurement extraction' ELSE 'verification' END"


@query(f"""{_JUDGED} SELECT {_EXPECTED} AS expected_outcome, outcome, CASE WHEN NOT {_FAILED} THEN 'passed' WHEN bad = 'unrun' THEN 'unrun' WHEN bad = 'api' THEN 'api_error' ELSE 'failed' END AS result, {_STAGE_SQL} AS failure_stage,
bad <> 'file' OR NOT citing AS retrieved, {_EXPECTED} = 'correction_proposed' AS wants_proposal, count(*) AS n FROM m GROUP BY ALL""")
def report_cases(spark, sf_dir):
    """The report's table of cases, counted by all but their ids and values."""
    rows = report.case_table(_judged(spark, sf_dir))
    return rows.groupBy("expected_outcome", "outcome", "result", "failure_stage", "retrieved", F.col("expected_proposal").isNotNull().alias("wants_proposal")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_JUDGED} SELECT {_STAGE_SQL} AS failure_stage, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM m), 1)::DOUBLE AS share FROM m GROUP BY 1""")
def report_stages(spark, sf_dir):
    """The report's table of stages."""
    return report.stage_table(_judged(spark, sf_dir)).drop("first_case")


@query(f"WITH s AS ({_SHEETS}), p AS ({_PART}) SELECT 'sheet-' || k || '.pdf' AS document_filename, CASE WHEN k % 5 = 0 THEN false ELSE true END AS in_page FROM p WHERE stated")
def citation_in_page(spark, sf_dir):
    """Whether a cited passage stands on its page; every fifth page has been changed since."""
    pages = sheets(spark, sf_dir)
    cited = pages.select(F.col("source_file").alias("document_filename"), "page_number", rx.section_or_page(F.col("text"), F.lit("thickness")).alias("s")).filter("s.context_type = 'section'").select("document_filename", "page_number", F.col("s.passage").alias("supporting_passage"))
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    return evidence.cited_pages(cited, pages.withColumn("text", F.when(k % 5 == 0, F.regexp_replace("text", "thickness", "thinness")).otherwise(F.col("text")))).select("document_filename", "in_page")


# --- strategies that are run against each other, over many corpora ---
#: Each part's sheet lies in a corpus of its own fifth. Another corpus has the same sheet with another thickness. By k % 6 a case asks
#: in lower case (0) or without a revision (1), which patterns forgive and keys don't, or its corpus has a text that says 77.5 of
#: what was made in the part's place (2), which names the part and so misleads patterns, but has keys of its own.
_CASES = f"""
WITH p AS ({_PART}),
t AS (SELECT k, k % 6 AS kind, component, revision, v1, unit, stated, twice, tupled, CASE WHEN NOT stated THEN 'insufficient_evidence' WHEN twice AND NOT tupled THEN 'ambiguous_evidence' WHEN unit = 'in' THEN 'needs_review' ELSE 'correction_proposed' END AS truth FROM p)
"""
_NOTES = f"""
SELECT 'note-' || k || '.pdf' AS source_file, 1 AS page_number, 'Component ID: N-' || k || chr(10) || 'Revision: ' || revision || chr(10) || 'Document ID: NOTE-' || k || chr(10) || '1. Note' || chr(10) || 'Made in place of ' || component || '.' || chr(10) || 'Nominal thickness: 77.5 mm.' AS text, k
FROM ({_PART}) p WHERE k % 6 = 2
"""


def _dealt(spark, sf_dir):
    """Cases (records with corpus_id), pages of all corpora, and expected answers, derived from the part alone."""
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    corpus = lambda n: F.concat(F.lit("corpus-"), (n % 5).cast("string"))
    own = sheets(spark, sf_dir).withColumn("corpus_id", corpus(k))
    twin = sheets(spark, sf_dir).withColumns({"corpus_id": corpus(k + 1), "text": F.regexp_replace("text", r"(thickness: |33\.5 [a-z]+ x )[0-9.]+", "$199.5")})
    notes = _sql(spark, sf_dir, _NOTES.replace("FROM part", "FROM {part}"), part="part").withColumn("corpus_id", corpus(F.col("k"))).drop("k")
    of_part = lambda what: _sql(spark, sf_dir, f"{_CASES.replace('FROM part', 'FROM {part}')} SELECT {what}", part="part")
    facts = of_part("* FROM t").join(grown(of_part("k, v2 FROM p")), "k")
    n, truth = F.col("k").cast("string"), F.col("truth")
    value = F.when(F.col("twice") & F.col("tupled"), F.col("v2")).otherwise(F.col("v1"))
    line = F.when(F.col("tupled") & ~F.col("twice"), F.concat(F.lit("Envelope (depth, breadth, thickness): 71.25 "), "unit")).otherwise(F.concat(F.when(F.col("twice"), "Measured").otherwise("Nominal"), F.lit(" thickness: "), value, F.lit(" "), "unit", F.lit(".")))
    cites, corrects = truth.isin("needs_review", "correction_proposed"), truth == "correction_proposed"
    cases = facts.select(
        F.concat(F.lit("case-"), n).alias("case_id"), n.alias("record_id"), corpus(F.col("k")).alias("corpus_id"), F.when(F.col("kind") == 0, F.lower("component")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("kind") != 1, F.col("revision")).alias("revision"), F.lit("thickness").alias("attribute_name"), F.lit("0.125").alias("recorded_value"), F.lit("mm").alias("recorded_unit"),
    )
    want = facts.select(
        F.concat(F.lit("case-"), n).alias("case_id"), truth.alias("expected_outcome"), F.when(corrects, value.cast("double") * F.when(F.col("unit") == "cm", 10).otherwise(1)).alias("expected_value"), F.when(corrects, "mm").alias("expected_unit"),
        F.when(cites, F.concat(F.lit("sheet-"), n, F.lit(".pdf"))).alias("expected_file"), F.when(cites, 1).alias("expected_page"), F.when(cites, line).alias("expected_passage"),
    )
    return cases, own.unionByName(twin).unionByName(notes), want


def _profiled(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """With a vector of how often the letters a to z stand in text, so that SQL can say the same."""
    t = F.translate(text, _LETTERS.upper(), _LETTERS)
    return rows.withColumn(out, F.array(*((F.length(t) - F.length(F.translate(t, c, ""))).cast("float") for c in _LETTERS)))


def _corpus_chunks(pages: DataFrame) -> DataFrame:
    rows, _ = store.corpora(pages)
    return _profiled(rows, F.col("text"), "embedding").withColumns({"model_name": F.lit("m"), "model_revision": F.lit("1")})


@query(f"""{_CASES}, o AS (SELECT truth, kind <> 2 OR (twice AND NOT tupled) AS a, (kind NOT IN (0, 1) AND NOT (twice AND tupled AND unit <> 'in')) OR NOT stated AS b FROM t)
SELECT count(*) AS n, count(*) FILTER (a AND b) AS n_same, round(100.0 * count(*) FILTER (a AND b) / count(*), 1)::DOUBLE AS concordance, count(*) FILTER (NOT a AND b) AS improved, count(*) FILTER (a = b) AS matched, count(*) FILTER (a AND NOT b) AS worsened FROM o""")
def retriever_comparison(spark, sf_dir):
    """Both strategies over the cases of five corpora, judged against the same answers. Where a chunk holds both a list and a line of its
    own, patterns cite the line, and the vector strategy the chunk, whose list is read first."""
    cases, pages, want = _dealt(spark, sf_dir)
    asked = _profiled(cases, evidence.query_text(F.col("component_id"), F.col("attribute_name")), "query_vector")
    patterns = evaluate.cases(plan.audit(cases, pages), want)
    vectors = evaluate.cases(plan.audit(asked, retriever="vector", chunks=_corpus_chunks(pages)), want)
    return evaluate.changes(evaluate.comparison(patterns, vectors, names=("baseline", "vector")))


@query(f"""{_CASES}, x AS (SELECT CASE WHEN unit = 'cm' AND truth = 'correction_proposed' AND kind <> 2 THEN 'needs_review' END AS told, kind <> 2 OR (twice AND NOT tupled) AS a FROM t),
o AS (SELECT a, a AND told IS NULL AS b, told IS NULL AS same FROM x)
SELECT count(*) AS n, count(*) FILTER (same) AS n_same, round(100.0 * count(*) FILTER (same) / count(*), 1)::DOUBLE AS concordance, count(*) FILTER (NOT a AND b) AS improved, count(*) FILTER (a = b) AS matched, count(*) FILTER (a AND NOT b) AS worsened FROM o""")
def extractor_comparison(spark, sf_dir):
    """The built-in extractor and a model, over the same cases; the model turns cm into mm by itself, which the guards don't let through."""
    return evaluate.changes(evaluate.comparison(*_two_extractors(spark, sf_dir), names=("deterministic", "model")))


def _two_extractors(spark, sf_dir):
    cases, pages, want = _dealt(spark, sf_dir)

    def told(passage: str, attribute: str) -> dict | str:
        said = _told(passage, attribute)
        return {**said, "value": str(10 * float(said["value"])), "unit": "mm"} if said.get("unit") == "cm" else said

    ledger = CallLedger(spark, folder(spark, "calls"))
    own = evaluate.cases(plan.audit(cases, pages), want)
    asked = evaluate.cases(plan.audit(cases, pages, extractor=model.by_model(model.offline(told), ledger=ledger)), want)
    return own, asked


@query(f"""{_CASES}, x AS (SELECT truth, NOT (unit = 'cm' AND truth = 'correction_proposed' AND kind <> 2) AS told, kind <> 2 OR (twice AND NOT tupled) AS a FROM t),
o AS (SELECT truth, r.name, r.passed FROM (SELECT truth, unnest([{{name: 'deterministic', passed: a}}, {{name: 'model', passed: a AND told}}]) AS r FROM x)),
s AS (SELECT name, count(*)::DOUBLE AS n, count(*) FILTER (passed)::DOUBLE AS n_passed, count(*) FILTER (NOT passed)::DOUBLE AS n_failed, round(100.0 * count(*) FILTER (passed) / count(*), 1)::DOUBLE AS pass_rate,
  round(100.0 * count(*) FILTER (passed AND truth = 'correction_proposed') / count(*) FILTER (truth = 'correction_proposed'), 1)::DOUBLE AS correction_rate,
  round(100.0 * count(*) FILTER (passed AND truth <> 'correction_proposed') / count(*) FILTER (truth <> 'correction_proposed'), 1)::DOUBLE AS abstention_rate FROM o GROUP BY name),
u AS (UNPIVOT s ON n, n_passed, n_failed, pass_rate, correction_rate, abstention_rate INTO NAME metric VALUE value)
SELECT metric, d.value AS deterministic, m.value AS model, round(m.value - d.value, 4) AS difference, CASE WHEN m.value = d.value THEN 'same' WHEN m.value > d.value THEN 'model' ELSE 'deterministic' END AS higher
FROM u d JOIN u m USING (metric) WHERE d.name = 'deterministic' AND m.name = 'model'""")
def report_metrics(spark, sf_dir):
    """The report's table of two extractors' metrics side by side."""
    wanted = ("n", "n_passed", "n_failed", "pass_rate", "correction_rate", "abstention_rate")
    return report.metric_table(*(evaluate.summary(run).select(*wanted) for run in _two_extractors(spark, sf_dir)), names=("deterministic", "model"))


_COUNTED = "[" + ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


@query(f"""{_CHUNKS_SQL}, h AS (SELECT k, n, start_char, translate(t, '{_LETTERS.upper()}', '{_LETTERS}') AS t FROM c WHERE k % 6 NOT IN (0, 1)),
v AS (SELECT k, n, start_char, {_COUNTED} AS e FROM h), q AS (SELECT k, {_COUNTED} AS q FROM (SELECT DISTINCT k, translate('Component P-' || k || ' thickness physical dimension parameter specification', '{_LETTERS.upper()}', '{_LETTERS}') AS t FROM h)),
d AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY round(1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6), start_char) AS rank FROM v JOIN q USING (k)),
g AS (SELECT k, stated AND NOT (twice AND NOT tupled) AS gold FROM ({_PART}) p)
SELECT 'case-' || k AS case_id, CASE WHEN k % 6 NOT IN (0, 1) THEN (SELECT d.rank FROM d WHERE d.k = g.k AND d.n = 3) END AS first_rank FROM g WHERE gold""")
def retriever_ranks(spark, sf_dir):
    """The rank by distance, among the chunks of the case's corpus that carry its keys, of the one that holds the expected passage."""
    cases, pages, want = _dealt(spark, sf_dir)
    asked = _profiled(cases, evidence.query_text(F.col("component_id"), F.col("attribute_name")), "query_vector")
    ranked = retrieve.ranked(_corpus_chunks(pages), asked.select(F.col("case_id").alias("query_id"), "corpus_id", "component_id", "revision", "query_vector"), keys=("corpus_id", "component_id", "revision"))
    return evaluate.evidence_ranks(ranked, want).select("case_id", F.col("first_rank").cast("bigint").alias("first_rank"))


_ADDED = ("Zigzag fizz of the quay.", "Thickness is one of its dimensions.")


@query(f"""{_CHUNKS_SQL}, h AS (SELECT c.k, stated, twice, tupled, unnest(['sheet-', 'copy-']) || c.k || '.pdf' AS file, unnest([c.t, c.t || chr(10) || CASE WHEN c.k % 2 = 0 THEN '{_ADDED[0]}' ELSE '{_ADDED[1]}' END]) AS own FROM c JOIN ({_PART}) p ON p.k = c.k WHERE n = 3),
v AS (SELECT *, {_COUNTED} AS e FROM (SELECT *, translate(own, '{_LETTERS.upper()}', '{_LETTERS}') AS t FROM h WHERE stated OR (k % 2 = 1 AND file LIKE 'copy-%'))),
q AS (SELECT k, {_COUNTED} AS q FROM (SELECT k, translate('Component P-' || k || ' thickness physical dimension parameter specification', '{_LETTERS.upper()}', '{_LETTERS}') AS t FROM ({_PART}) p)),
d AS (SELECT v.k, file, own, 1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS distance FROM v JOIN q ON v.k = q.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY distance, file) AS rn FROM d)
SELECT p.k || '' AS qid, CASE WHEN twice AND NOT tupled THEN 'ambiguous_evidence' WHEN r.k IS NULL THEN 'insufficient_evidence' ELSE 'evidence_found' END AS retrieval_status,
CASE WHEN NOT (twice AND NOT tupled) THEN file END AS document_filename, CASE WHEN NOT (twice AND NOT tupled) THEN own END AS passage, CASE WHEN NOT (twice AND NOT tupled) THEN round(1 - distance, 4) END AS similarity
FROM ({_PART}) p LEFT JOIN r ON r.k = p.k AND rn = 1""")
def vector_citations(spark, sf_dir):
    """What the vector strategy cites where two texts of a part say the same: the nearest chunk with a direct line, else the nearest
    one that mentions the attribute, and its similarity. By k the text that has a line added is nearer or farther."""
    k = F.regexp_extract("source_file", r"(\d+)", 1)
    own = sheets(spark, sf_dir)
    line = F.when(k.cast("bigint") % 2 == 0, _ADDED[0]).otherwise(_ADDED[1])
    copy = own.withColumns({"source_file": F.concat(F.lit("copy-"), k, F.lit(".pdf")), "text": F.replace(F.col("text"), F.lit("3. Remarks"), F.concat(line, F.lit("\n3. Remarks")))})
    chunks = _profiled(chunking.chunks(own.unionByName(copy)), F.col("text"), "embedding").withColumns({"model_name": F.lit("m"), "model_revision": F.lit("1")})
    asked = _sql(spark, sf_dir, f"SELECT k || '' AS qid, component, revision, 'thickness' AS attribute FROM ({_PART.replace('FROM part', 'FROM {part}')}) p", part="part")
    asked = _profiled(asked, evidence.query_text(F.col("component"), F.col("attribute")), "query_vector")
    return retrieve.vector(asked, chunks=chunks, dimension=len(_LETTERS)).select("qid", "retrieval_status", "document_filename", "passage", "similarity")


@query(f"""{_CHUNKS_SQL} SELECT 'case-' || k AS case_id, CASE WHEN k % 3 = 2 THEN NULL ELSE 3 END::INT AS first_rank FROM c WHERE n = 1""")
def evidence_rank(spark, sf_dir):
    """The rank, by offset, of the chunk that is from the expected page and holds the expected passage but for white space; every third answer names another page."""
    pages = sheets(spark, sf_dir)
    k = lambda c: F.regexp_extract(c, r"(\d+)", 1)
    own = chunking.chunks(pages).withColumn("query_id", F.concat(F.lit("case-"), k("document_filename")))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("start_char"))).select("query_id", "rank", "document_filename", "page_number", "text")
    want = pages.select(F.concat(F.lit("case-"), k("source_file")).alias("case_id"), F.col("source_file").alias("expected_file"), F.when(k("source_file").cast("bigint") % 3 == 2, 9).otherwise(1).alias("expected_page"), F.lit("2.  Physical\ndata").alias("expected_passage"))
    return evaluate.evidence_ranks(ranked, want)


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'found' WHEN 1 THEN 'found' WHEN 2 THEN 'insufficient' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'found' WHEN 5 THEN 'found' WHEN 7 THEN 'sure' END AS status,
CASE event_id % 8 WHEN 4 THEN 'fields that are missing: unit, quote' WHEN 5 THEN 'the value isn''t a decimal' WHEN 6 THEN 'the answer isn''t a JSON object' WHEN 7 THEN 'the answer has no known status' END AS problem FROM events""")
def model_responses(spark, sf_dir):
    """Answers of a model: fenced, with fields missing, with a value that is no number, with an unknown status, and not JSON."""
    good = '{"status": "found", "measurement_name": "depth", "value": "1.5", "unit": "mm", "quote": "depth 1.5 mm"}'
    said = (good, f"```json\n{good}\n```", '{"status": "insufficient"}', '{"status": "ambiguous", "quote": null}', '{"status": "found", "measurement_name": "depth", "value": "1.5"}', good.replace("1.5", "one"), "I think it is 1.5 mm", '{"status": "sure"}')
    text = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 8 + 1).cast("int"))
    r = model.response(text)
    return _table(spark, sf_dir, "events").select("event_id", r["status"].alias("status"), r["problem"].alias("problem"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 11 = 0) AS n_dimension, count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 7 = 0) AS n_not_finite, count(*) FILTER (vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0) AS n_norm, count(*) FILTER (vec_id % 3 = 0 OR vec_id % 13 = 0) AS n_fields FROM embeddings""")
def artifact_validation(spark, sf_dir):
    """Chunks with planted faults: vectors too short, with a NaN, not of unit length, and fields that are missing or empty."""
    k = F.col("vec_id")
    nan = F.transform("embedding", lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v).cast("float"))
    vec = F.when(k % 11 == 0, F.slice("embedding", 1, 9)).when(k % 7 == 0, nan).when(k % 5 == 0, F.transform("embedding", lambda v: (v * 2).cast("float"))).otherwise(F.col("embedding"))
    rows = _table(spark, sf_dir, "embeddings").select(vec.alias("embedding"), *(F.lit("x").alias(c) for c in store.REQUIRED if c not in ("text", "revision")), F.when(k % 3 == 0, "").otherwise("x").alias("text"), F.when(k % 13 != 0, "A").alias("revision"))
    return store.violations(rows, 64)


def _vector_chunks(spark, sf_dir):
    """The table's vectors as chunks of many corpora."""
    id_ = F.col("vec_id").cast("string")
    fixed = {"document_filename": "x.pdf", "page_number": 1, "start_char": 0, "end_char": 9, "token_count": 1, "revision": "A"}
    own = (F.concat(F.lit("corpus-"), F.col("label").cast("string")).alias("corpus_id"), id_.alias("chunk_id"), F.concat(F.lit("line 1\n"), id_).alias("text"), F.sha2(id_, 256).alias("content_sha256"), F.lit("P").alias("component_id"))
    return _table(spark, sf_dir, "embeddings").select(*own, *(F.lit(v).alias(c) for c, v in fixed.items()), "embedding")


_VALUES_SQL = "len(embedding) AS width, embedding[1]::DOUBLE AS first_value, embedding[-1]::DOUBLE AS last_value, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high"


def _values() -> tuple[Column, ...]:
    e, d = F.col("embedding"), lambda c: c.cast("double")
    return F.size(e).cast("bigint").alias("width"), d(F.element_at(e, 1)).alias("first_value"), d(F.element_at(e, -1)).alias("last_value"), d(F.array_min(e)).alias("low"), d(F.array_max(e)).alias("high")


@query(f"SELECT 'corpus-' || label AS corpus_id, vec_id || '' AS chunk_id, 'line 1' || chr(10) || vec_id AS text, {_VALUES_SQL} FROM embeddings")
def artifact_by_position(spark, sf_dir):
    """An artifact whose vectors are rows of .npy files, which its chunks meet by their place."""
    at = folder(spark, "positional")
    store.save_artifacts(_vector_chunks(spark, sf_dir), at, "vectors", "1", 64, positional=True)
    return store.load_artifacts(spark, at, 64).select("corpus_id", "chunk_id", "text", *_values())


@query(f"SELECT row_number() OVER (ORDER BY 'corpus-' || label, vec_id || '') - 1 AS position, {_VALUES_SQL} FROM embeddings")
def vector_file_rows(spark, sf_dir):
    """The rows of .npy files of a few vectors each, read by ranges of bytes, in the order of the chunks' keys."""
    at, rows = folder(spark, "npy"), running(_vector_chunks(spark, sf_dir), store.KEY)
    npy.write(rows, at, 64, rows_per_file=100)
    return npy.read(spark, at, 64, range_bytes=16 << 10).select("position", *_values())


@query("SELECT 'no table' AS kind, 'error' AS retrieval_status, 'DATABASE_ERROR' AS error_type, count(*) AS n, 502 AS status_code FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT 'dimension', CASE WHEN vec_id % 40 = 0 THEN 'error' ELSE 'insufficient_evidence' END, CASE WHEN vec_id % 40 = 0 THEN 'MODEL_INCOMPATIBLE' END, count(*), CASE WHEN vec_id % 40 = 0 THEN 502 ELSE 200 END FROM embeddings WHERE vec_id % 20 = 0 GROUP BY ALL")
def retrieval_errors(spark, sf_dir):
    """Questions without a chunk table, and with a query vector of another dimension."""
    v = _table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    asked = v.select(F.col("vec_id").cast("string").alias("qid"), F.lit("nobody").alias("component"), F.lit("A").alias("revision"), F.lit("depth").alias("attribute"), F.when(F.col("vec_id") % 40 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")).alias("query_vector"))
    chunks = spark.createDataFrame([], store.SCHEMA)
    out = None
    for kind, table in (("no table", None), ("dimension", chunks)):
        found = retrieve.vector(asked, chunks=table, dimension=64).withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    status = plan.http_status(F.when(F.col("error_type") == retrieve.DATABASE_ERROR, "database").when(F.col("error_type") == retrieve.MODEL_INCOMPATIBLE, "model"))["status_code"]
    return out.groupBy("kind", "retrieval_status", "error_type", status.alias("status_code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({_PART}), c AS (SELECT k % 37 AS g, bool_or(k % 53 = 0) AS bad, count(*) AS n FROM p GROUP BY 1) SELECT 'corpus-' || g AS corpus_id, CASE WHEN bad THEN 0 ELSE 4 * n END AS chunks, bad AS rejected FROM c")
def multi_corpus(spark, sf_dir):
    """Many corpora at once: one with a text whose identity isn't clear is left out as a whole."""
    k = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    pages = sheets(spark, sf_dir).withColumns({"corpus_id": F.concat(F.lit("corpus-"), (k % 37).cast("string")), "text": F.when(k % 53 == 0, F.regexp_replace("text", "Revision:", "Edition:")).otherwise(F.col("text"))})
    rows, rejected = store.corpora(pages)
    per = rows.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("chunks")).unionByName(rejected.select("corpus_id", F.lit(0).cast("bigint").alias("chunks")))
    return per.join(rejected.select("corpus_id", F.lit(True).alias("rejected")), "corpus_id", "left").select("corpus_id", "chunks", F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query(f"{_CHUNKS_SQL} SELECT CASE WHEN k % 10 = 0 THEN 'missing' WHEN k % 10 = 1 THEN 'changed' WHEN k % 10 = 2 THEN 'unexpected' END AS kind, CASE WHEN k % 10 = 1 THEN 'token_count,revision' END AS fields, count(*) AS n FROM c WHERE k % 10 < 3 GROUP BY ALL")
def stored_differences(spark, sf_dir):
    """A table against what it should hold: chunks that are missing, changed, and not expected."""
    rows = chunking.chunks(sheets(spark, sf_dir)).withColumn("k", F.regexp_extract("document_filename", r"(\d+)", 1).cast("bigint") % 10)
    held = rows.filter("k != 0").withColumns({"token_count": F.when(F.col("k") == 1, 0).otherwise(F.col("token_count")), "revision": F.when(F.col("k") == 1, "?").otherwise(F.col("revision"))})
    return store.differences(held, rows.filter("k != 2")).groupBy("kind", "fields").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CHUNKS_SQL} SELECT count(*) FILTER (component = 'P-5' AND revision = 'C') AS n_match, count(*) AS some_component_id, 0::BIGINT AS none_component_id, count(*) AS some_revision, 0::BIGINT AS none_revision FROM c")
def identity_counts(spark, sf_dir):
    return store.counts(chunking.chunks(sheets(spark, sf_dir)), component_id="P-5", revision="C")


@query("SELECT l_orderkey, l_linenumber, (n * 10 + 5)::DOUBLE AS converted, l_linenumber % 2 = 0 AS agrees, n || '.5 cm x 10 = ' || (n * 10 + 5) || ' mm' AS calculation FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n FROM lineitem)")
def conversion_agrees(spark, sf_dir):
    """The conversion as a tool: what a stated value is in the record's unit, and whether the record agrees."""
    n = F.col("l_quantity").cast("int")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(n.cast("string"), F.lit(".5")).alias("v"), F.when(F.col("l_linenumber") % 2 == 0, (n * 10 + 5).cast("string")).otherwise("1").alias("r")).distinct()
    c = measure.comparison(F.col("v"), F.lit("cm"), F.col("r"), F.lit("mm"))
    return rows.select("l_orderkey", "l_linenumber", c["converted"].cast("double").alias("converted"), c["agrees"].alias("agrees"), c["calculation"].alias("calculation"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN NULL ELSE NULL END AS agrees FROM events")
def exact_decimals(spark, sf_dir):
    """Values that differ in the fourteenth digit, with seventeen digits before the point, and with more digits than are kept."""
    pairs = (("0.1234567890123", "0.12345678901234"), ("1.50", "1.5000"), ("99999999999999998", "99999999999999999"), ("1e3", "1000"), ("0.12345678901234567", "0.1"), ("1234567890123456789", "1"))
    at = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), (F.col("event_id") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", measure.comparison(at(1), F.lit("mm"), at(0), F.lit("mm"))["agrees"].alias("agrees"))


@query("SELECT event_id, [NULL, 'component', 'attribute', 'unit', 'value', 'extractor', 'retriever', 'component,attribute,unit,value'][1 + event_id % 8] AS broken FROM events")
def request_rules(spark, sf_dir):
    """Requests that break each of the rules, none of them, and several."""
    k = F.col("event_id") % 8
    off = lambda *ks: k.isin(*ks, 7)
    rows = _table(spark, sf_dir, "events").select(
        "event_id", F.when(off(1), " ").otherwise("Q1").alias("component_id"), F.lit(None).cast("string").alias("part_number"), F.when(off(2), "").otherwise("depth").alias("attribute_name"), F.when(off(3), None).otherwise("mm").alias("recorded_unit"),
        F.when(off(4), "many").otherwise("1").alias("recorded_value"), F.when(k == 5, "oracle").otherwise("deterministic").alias("extractor"), F.when(k == 6, "guess").otherwise("Postgres").alias("retriever"),
    )
    return plan.violations(rows).select("event_id", F.nullif(F.array_join("violations", ","), F.lit("")).alias("broken"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'part-' || event_id ELSE 'c' || event_id END AS component_id, CASE event_id % 3 WHEN 0 THEN 'part-' || event_id WHEN 1 THEN 'p' ELSE 'c' || event_id END AS part_number, CASE event_id % 3 WHEN 0 THEN 'width' WHEN 1 THEN 'depth' ELSE 'height' END AS attribute_name, 'mm' AS recorded_unit,
CASE event_id % 3 WHEN 0 THEN '{"filename":"a.pdf"}' WHEN 1 THEN '{"document_id":"D1"}' END AS document_reference FROM events""")
def request_records(spark, sf_dir):
    """Requests as records: other names, the unit's blanks, and references without the client's paths."""
    k = F.col("event_id") % 3
    own = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"), F.when(k != 0, own).alias("component_id"), F.when(k == 0, F.concat(F.lit("part-"), F.col("event_id").cast("string"))).when(k == 1, "p").alias("part_number"), F.when(k == 1, "depth").when(k == 2, "").alias("attribute_name"),
        F.when(k == 0, "width").alias("attribute"), F.lit("height").alias("measurement"), F.lit("1").alias("recorded_value"), F.lit(" mm ").alias("recorded_unit"), F.when(k == 0, "a.pdf").when(k == 1, '{"document_id": "D1", "filepath": "/etc/x"}').alias("document_reference"),
    )
    return plan.normalized_request(rows).select(F.col("record_id").cast("bigint").alias("event_id"), "component_id", "part_number", "attribute_name", "recorded_unit", "document_reference")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'r' || event_id WHEN 1 THEN 'UNKNOWN-CASE' ELSE 'k' || event_id END AS case_id, CASE event_id % 4 WHEN 1 THEN 'UNKNOWN-RECORD' WHEN 2 THEN 'k' || event_id ELSE 'r' || event_id END AS record_id, CASE event_id % 4 WHEN 2 THEN 'UNKNOWN-COMP' WHEN 3 THEN 'c' ELSE 'p' END AS component_id, CASE event_id % 4 WHEN 3 THEN 'unknown_attribute' ELSE 'depth' END AS attribute_name FROM events""")
def record_fallbacks(spark, sf_dir):
    """Records with missing and empty fields: other names first, then placeholders."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    rows = _table(spark, sf_dir, "events").select(
        n.alias("recorded_value"), F.when(k.isin(2, 3), F.concat(F.lit("k"), n)).otherwise("").alias("case_id"), F.when(k.isin(0, 3), F.concat(F.lit("r"), n)).alias("record_id"), F.when(k == 3, "c").otherwise("").alias("component_id"), F.when(k != 2, "p").alias("part_number"),
        F.when(k == 0, "depth").alias("attribute_name"), F.when(k == 1, "depth").alias("attribute"), F.when(k == 2, "depth").alias("measurement"),
    )
    return plan.normalize(rows).select(F.col("recorded_value").cast("bigint").alias("event_id"), "case_id", "record_id", "component_id", "attribute_name")


@query(f"WITH p AS ({_PART}) SELECT kind || '/' || k AS qid, 'sheet-' || k || '.pdf' AS source_file FROM p, (VALUES ('dotted'), ('han')) t(kind)")
def component_pattern_join(spark, sf_dir):
    """Components whose ids hold other characters than letters, digits, _ and -, and one that holds none of these."""
    k = F.regexp_extract("source_file", r"(\d+)", 1)
    sign = lambda n: F.decode(F.unhex(F.hex(F.lit(0x4E00) + n)), "UTF-16BE")
    ids = {"dotted": F.concat(F.lit("X."), k, F.lit("/a")), "han": F.concat(sign(k.cast("bigint") % 20000), sign(F.floor(k.cast("bigint") / 20000)))}
    pages = sheets(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nAlso known as "), ids["dotted"], F.lit(" and "), ids["han"], F.lit(".")))
    q = pages.select(F.explode(F.array(*(F.struct(F.concat_ws("/", F.lit(n), k).alias("qid"), c.alias("component")) for n, c in ids.items()))).alias("q")).select("q.*", F.lit(None).cast("string").alias("revision"), F.lit("depth").alias("attribute"), F.lit(None).cast("string").alias("stem"))
    return retrieve.eligible(q, pages).select("qid", "source_file")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, vec_id, round(1 - round(1 - list_inner_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[]))), 6), 6) AS similarity FROM q JOIN embeddings ON true)
SELECT query_id, max(similarity) AS best FROM d WHERE vec_id <> query_id GROUP BY 1""")
def similarity_order(spark, sf_dir):
    """The similarity of the nearest other vector, in the order of descending similarity."""
    near = _others(*_vectors(spark, sf_dir), 1)
    return near.select("query_id", F.round(1 - F.col("distance"), 6).alias("best")).orderBy(F.desc("best"))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'case-' WHEN event_id % 4 = 1 THEN 'challenge-' END || event_id AS case_id, event_id % 3 = 0 AS blocks FROM events WHERE event_id % 4 < 2 AND event_id % 3 = 0")
def regression_gate(spark, sf_dir):
    """Of the cases of all suites those that fail and aren't known to; cases of other names belong to no suite."""
    k = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(F.concat(F.when(k % 4 == 0, "case-").when(k % 4 == 1, "challenge-").otherwise("draft-"), k.cast("string")).alias("case_id"), F.when(k % 3 == 0, "failed").when(k % 3 == 1, "unrun").otherwise("passed").alias("state"))
    return evaluate.failures(evaluate.suite(rows, "all"), ("case-x",)).select("case_id", F.lit(True).alias("blocks"))


@query("""SELECT 'c' || o_custkey % 5 AS corpus_id, count(*) AS n, sum((o_orderkey % 2 = 0)::INT)::BIGINT AS n_new FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1""")
def chunk_store(spark, sf_dir):
    """Two upserts into a stored table, the second of them twice: rows by corpus, and how many have the newer content."""
    table = store.ChunkStore(spark, f"{shared_dir(spark)}/attestor-chunks-{uuid.uuid4().hex}")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("corpus_id"), "o_orderkey")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], store.SCHEMA).schema}
    rest = lambda df, text: df.select("chunk_id", "corpus_id", F.lit(text).alias("text"), F.sha2(F.lit(text), 256).alias("content_sha256"), *(F.lit(None).cast(t).alias(n) for n, t in kinds.items() if n not in ("chunk_id", "corpus_id", "text", "content_sha256")))
    table.upsert(rest(o.filter("o_orderkey % 3 <> 0"), "old"))
    for _ in range(2):
        table.upsert(rest(o.filter("o_orderkey % 2 = 0"), "new"))
    return table.read().groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "new").alias("n_new"))


@query(f"""WITH p AS ({_PART}), f AS (SELECT *, CASE WHEN NOT stated THEN 'insufficient_evidence' WHEN twice AND NOT tupled THEN 'ambiguous_evidence' WHEN unit = 'in' THEN 'needs_review' ELSE 'correction_proposed' END AS o, stated AND NOT (twice AND NOT tupled) AS found FROM p)
SELECT k, CASE k % 6 WHEN 0 THEN 422 WHEN 1 THEN 422 WHEN 2 THEN 422 WHEN 3 THEN CASE WHEN found THEN 503 ELSE 200 END WHEN 4 THEN 502 ELSE 200 END AS status_code,
CASE k % 6 WHEN 0 THEN 'INVALID_REQUEST' WHEN 1 THEN 'INVALID_EXTRACTOR' WHEN 2 THEN 'INVALID_RETRIEVER' WHEN 3 THEN CASE WHEN found THEN 'PROVIDER_NOT_CONFIGURED' END WHEN 4 THEN 'RETRIEVER_SERVICE_ERROR' END AS error_code,
CASE k % 6 WHEN 0 THEN 'component' WHEN 1 THEN 'extractor' WHEN 2 THEN 'retriever' END AS violations, CASE WHEN k % 6 = 5 OR (k % 6 = 3 AND NOT found) THEN o END AS outcome FROM f""")
def http_responses(spark, sf_dir):
    """Requests that break a rule, ask a model without a provider, or a table that isn't there, and requests that are answered."""
    pages = sheets(spark, sf_dir)
    k = F.col("k") % 6
    rows = chunking.identities(pages).withColumn("k", F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")).select(
        "k", F.when(k != 0, F.col("component_id")).alias("component_id"), "revision", F.lit("thickness").alias("attribute_name"), F.lit("0.125").alias("recorded_value"), F.lit("mm").alias("recorded_unit"),
        F.when(k == 1, "oracle").when(k == 3, "gemini").alias("extractor"), F.when(k == 2, "guess").when(k == 4, "pgvector").alias("retriever"),
    )
    return service.respond(rows, pages, "k").select("k", "status_code", "error_code", "violations", F.get_json_object("body", "$.outcome").alias("outcome"))


@query("SELECT n % 8 AS kind, CASE n % 8 WHEN 0 THEN 'correction_proposed' WHEN 1 THEN 'no_change' WHEN 5 THEN 'ambiguous_evidence' WHEN 6 THEN 'needs_review' WHEN 7 THEN 'needs_review' ELSE 'insufficient_evidence' END AS outcome, count(*) AS n, count(*) AS n_passed FROM (SELECT row_number() OVER () - 1 AS n FROM part) GROUP BY ALL")
def generated_cases(spark, sf_dir):
    """As many made-up cases as there are parts, through the audit and against their expected answers."""
    rows, pages, want = fixtures.cases(spark, _table(spark, sf_dir, "part").count())
    done = evaluate.cases(plan.audit(rows, pages), want, pages)
    return done.groupBy((F.substring("case_id", 6, 9).cast("bigint") % 8).alias("kind"), "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


@query(f"""WITH p AS ({_PLANTED}) SELECT k || '' AS record_id, CASE WHEN s >= 18 THEN NULL ELSE (SELECT exit_code FROM ({_EXITS}) e(i, exit_code, outcome) WHERE i = s) END AS terminal_reason, (s >= 4)::INT AS searched, (s >= 8)::INT AS extracted, (s >= 17)::INT AS converted,
array_to_string(list_slice(['validate_record', 'retrieve_evidence', 'extract_measurement', 'validate_evidence', 'convert_and_compare'], 1, CASE WHEN s < 4 THEN 1 WHEN s < 8 THEN 2 WHEN s < 11 THEN 3 WHEN s < 17 THEN 4 ELSE 5 END), '>') || '>finalize' AS nodes FROM p""")
def graph_routes(spark, sf_dir):
    """The nodes that each planted record passes, the tools that are used for it, and why it ends."""
    tool = lambda n: F.col("orchestration.tool_invocations")[n]
    return _exits(spark, sf_dir).select(
        "record_id", F.col("orchestration.terminal_reason").alias("terminal_reason"), tool("evidence_retrieval_tool").alias("searched"), tool("measurement_extraction_tool").alias("extracted"),
        tool("measurement_conversion_tool").alias("converted"), F.array_join("orchestration.node_transitions", ">").alias("nodes"),
    )
