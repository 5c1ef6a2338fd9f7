"""The thin queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bpe, decontaminate, exact_dedup, fill_middle, line_dedup, near_dedup, period_runs, secrets, substring_dedup, token_counts, toxicity, url_filter, warc
from attestor.llm.common import scratch, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    found = ledger.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = secrets.spans_text(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)),
        F.sha2(text, 256).alias("base_sha256"),
        text.alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return found.withColumn("section_tokens", F.array_join("section_tokens", ","))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"), scratch(spark, "warc"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=3, threshold=(85, 100))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents, a tenth of which are given periods by a rule of their ids: with h the CRC-32 of the decimal
    doc_id and g = h // 10, where h % 10 is 0 each of the n words i >= a is word a + (i - a) % p, a = g % n and
    p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    cut = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("w", 1, F.col("a")), again), 1, F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(text).alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.period_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_near_dedup": op8_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_period_runs": op12_period_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": _pipeline,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL_10 = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""


def _spans_sql(kind: str, pattern: str, number: int, group: int, least: int) -> str:
    """Positions from the lengths of matches and of the gaps before them. The gaps are what is left around a mark."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {number} AS k, '{kind}' AS kind, own,
      coalesce(sum(gap + hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS s, hit
    FROM (SELECT doc_id, i, length(g[i]) AS gap, length(h[i]) AS hit, length(v[i]) AS own
      FROM (SELECT doc_id, h, v, g, unnest(generate_series(1, len(h))) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d)))
    QUALIFY own >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SQL_2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  {_spans_sql('assign', _ASSIGN, 0, 2, 8)}
  UNION ALL {_spans_sql('access', 'AKIA[A-Z0-9]+', 1, 0, 16)}
  UNION ALL {_spans_sql('hex', '[0-9a-f]+', 2, 0, 32)}),
a AS (SELECT doc_id, sum((k = 0)::INT)::BIGINT AS n_assign, sum((k = 1)::INT)::BIGINT AS n_access, sum((k = 2)::INT)::BIGINT AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + hit)::BIGINT, ',' ORDER BY s, k) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def _url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in rules) + " END"
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    url = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    times = lambda t: f"(len(regexp_extract_all(regexp_replace(low, '[^a-z0-9]', '\\0\\0', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)', 0)))"
    terms = url_filter.VOCABULARY
    strict = " + ".join(times(t.replace("-", "--")) for t, w in terms.items() if w >= url_filter.STRICT_WEIGHT)
    soft = {t: w for t, w in terms.items() if w < url_filter.STRICT_WEIGHT}
    n_soft, weight = " + ".join(map(hit, soft)), " + ".join(f"{w} * {hit(t)}" for t, w in soft.items())
    return f"""
    WITH u AS (SELECT page_id, coalesce({url}, '') AS low, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    c AS (SELECT page_id, host, path, {case('name')} AS rule, {case('verdict')} AS v, ({strict})::INT AS n_strict, ({n_soft})::INT AS n_soft, ({weight})::INT AS soft_weight FROM u)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN n_strict > 0 OR (n_soft > 1 AND soft_weight >= {url_filter.SOFT_LEAST}) THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, soft_weight FROM c
    """


_SQL_7 = """
WITH b32 AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a),
p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr(a, 1 + (
    (('0x' || substr(x, 1 + 10 * (i // 8)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g, b32
"""

_SQL_8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS sh FROM w) WHERE i <= greatest(n - 2, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * m >= 85 * (cx.n + cy.n - m)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

_SQL_9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
k AS (SELECT doc_id, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS span FROM w),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1 AS again FROM k WHERE i <= n - 19),
c AS (SELECT k.doc_id, k.i, k.word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM k LEFT JOIN a ON a.doc_id = k.doc_id AND a.i = k.i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

_SQL_11 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own FROM l),
s AS (SELECT own, max(doc_id) AS top FROM k WHERE length(own) >= 20 GROUP BY own HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> s.top, FALSE) AS gone FROM k LEFT JOIN s ON s.own = k.own)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

#: A run of at least max(24, 3q) words with period q repeats a sequence of 16 words at the distance q, and such pairs in a row make a run.
_SQL_12 = """
WITH b AS (SELECT doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
c AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, xor(list_reduce(list_transform(range(0, 8 * length(s)), lambda j: (ascii(substr(s, j // 8 + 1, 1)) >> (j % 8)::INT)::BIGINT & 1),
  lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b),
g AS (SELECT doc_id, ws, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM c),
w AS (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM g)),
k AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS span FROM w QUALIFY i <= n - 16),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON y.doc_id = x.doc_id AND y.span = x.span AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
u AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM u WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
e AS (SELECT doc_id, pos, sum(step) AS step FROM (SELECT doc_id, start + period AS pos, 1 AS step FROM r UNION ALL SELECT doc_id, start + length, -1 FROM r) GROUP BY doc_id, pos),
o AS (SELECT w.doc_id, w.i, word, sum(coalesce(step, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS inside FROM w LEFT JOIN e ON e.doc_id = w.doc_id AND e.pos = w.i),
z AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM o WHERE inside = 0 GROUP BY doc_id)
SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, t.start, t.length, t.period, 1000 * t.length // t.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN f ON f.doc_id = c.doc_id LEFT JOIN t ON t.doc_id = c.doc_id LEFT JOIN z ON z.doc_id = c.doc_id
"""

_SQL_13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

ORACLES = {"op7_warc": _SQL_7, "op2_secret_scan": _SQL_2, "op5_url_filter": _url_sql(), "op8_near_dedup": _SQL_8, "op9_substring_dedup": _SQL_9, "op10_exact_dedup": _SQL_10,
           "op11_line_dedup": _SQL_11, "op12_period_runs": _SQL_12, "op13_fill_in_middle": _SQL_13}
