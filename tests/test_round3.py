"""Scans with an error channel, atomic upserts, first errors, exact medians, stage times, and retrieval over many corpora."""

import json
import math
import random
import re
import statistics
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor.functions import rx
from attestor.operators import evaluate, retrieve
from attestor.plans import audit
from attestor.sources import readers, store

# --- scans ---


def line(name, *texts):
    return json.dumps({"source_file": name, "pages": [{"page_number": i + 1, "text": t} for i, t in enumerate(texts)]}, ensure_ascii=False)


def test_a_broken_line_costs_itself(spark, tmp_path):
    """Whichever line is broken, the others stay; a file of one object over many lines is one object."""
    for place in range(3):
        folder = tmp_path / f"f{place}"
        folder.mkdir()
        lines = [line(f"{i}.pdf", f"té {i}") for i in range(2)]
        lines.insert(place, '{"source_file": "cut')
        (folder / "a.jsonl").write_text("\n".join([*lines, "", line("x.pdf", "x") + " and more", '["no object"]', '{"pages": []}', line("empty.pdf"), '"text"']) + "\n")
        (folder / "b.json").write_text(json.dumps(json.loads(line("b.pdf", "x", "y")), indent=2))
        (folder / "c.json").write_text("not JSON\nat all")
        (folder / "d.json").write_text("")
        pages, bad = readers.pages_and_errors(spark, str(folder))
        assert sorted((r.source_file, r.page_number, r.text) for r in pages.collect()) == [("0.pdf", 1, "té 0"), ("1.pdf", 1, "té 1"), ("b.pdf", 1, "x"), ("b.pdf", 2, "y")]
        assert [r.file.rsplit("/", 1)[1] for r in pages.select("file").distinct().orderBy("file").collect()] == ["a.jsonl", "b.json"]
        assert sorted((r.file.rsplit("/", 1)[1], r.error) for r in bad.collect()) == [("a.jsonl", "no pages"), ("a.jsonl", "no source_file"), ("a.jsonl", "not JSON"), ("a.jsonl", "not JSON"), ("a.jsonl", "not an object"), ("a.jsonl", "not an object"), ("c.json", "not JSON")]
        assert readers.read_pages(spark, str(folder)).count() == 4
        with pytest.raises(Exception, match="not JSON"):
            readers.read_pages(spark, str(folder), strict=True).collect()


def test_declared_layouts(spark, tmp_path):
    (tmp_path / "x.txt").write_text(line("1.pdf", "a") + "\n" + line("2.pdf", "b") + "\n")
    assert readers.read_pages(spark, str(tmp_path), layout=readers.LINES).count() == 2
    assert readers.errors(readers.scan(spark, str(tmp_path), readers.DOCUMENT, readers.OBJECTS)).count() == 1
    with pytest.raises(ValueError):
        readers.scan(spark, str(tmp_path), readers.DOCUMENT, "rows")


def test_lines_are_split(spark, tmp_path):
    """One file of lines is many tasks' work, and no line is lost or read twice at their borders."""
    (tmp_path / "big.jsonl").write_text("\n".join(line(f"{i}.pdf", "é" * (i % 90)) for i in range(5_000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
        rows = readers.scan(spark, str(tmp_path), readers.DOCUMENT)
        got = rows.select("block", "o.source_file").collect()
        assert len({r.block for r in got}) > 5 and sorted(r.source_file for r in got) == sorted(f"{i}.pdf" for i in range(5_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- the store ---


def chunk(spark, rows):
    columns = [f.split() for f in store.SCHEMA.split(", ")]
    own = spark.createDataFrame(rows, "corpus_id string, chunk_id string, text string")
    return own.select(*(F.col(n) if n in own.columns else F.sha2("text", 256).alias(n) if n == "content_sha256" else F.lit(None).cast(t).alias(n) for n, t in ((c[0], " ".join(c[1:])) for c in columns)))


def held(s):
    return sorted((r.corpus_id, r.chunk_id, r.text) for r in s.read().collect())


def test_an_upsert_counts_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, str(tmp_path / "table"))
    s.upsert(chunk(spark, [("a", "1", "old"), ("b", "1", "old"), ("c", "1", "old")]))
    first = s.read()
    new = chunk(spark, [("a", "1", "new"), ("b", "2", "new")])
    with monkeypatch.context() as m:
        m.setattr(store.ChunkStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the disk went away")))
        with pytest.raises(OSError):
            s.upsert(new)
    assert held(s) == [("a", "1", "old"), ("b", "1", "old"), ("c", "1", "old")]  # what was written has no head
    want = [("a", "1", "new"), ("b", "1", "old"), ("b", "2", "new"), ("c", "1", "old")]
    assert s.upsert(new) == 2 and held(s) == want
    assert sorted(r.text for r in first.collect()) == ["old"] * 3  # a reader keeps its head
    with pytest.raises(Exception):
        s._publish(s._head(), 1)  # another writer has put this one
    assert held(s) == want and s._names(f"{s.path}/heads").__len__() == 2
    for _ in range(3):
        s.upsert(new)
    assert held(s) == want and len(s._heads()) == store.ChunkStore.KEEP
    assert len(s._names(f"{s.path}/rows")) <= 4  # the versions of two heads: those of c, and the last ones of a and b


# --- evaluation ---


def test_first_error_as_by_a_window(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", "z", None]), r.choice([None, *range(40)]), i, r.random() < 0.05) for i in range(400)]
    df = spark.createDataFrame(rows, "run string, at int, id int, failed boolean")
    for within in ((), ("run",)):
        got = evaluate.abort_after_error(df, F.col("failed"), ("at", "id"), within)
        seen, want = {}, {}
        for run, at, i, failed in sorted(rows, key=lambda x: (-1 if x[1] is None else x[1], x[2])):
            k = run if within else 0
            want[i] = seen.get(k, False)
            seen[k] = seen.get(k, False) or failed
        assert {x.id: x.unrun for x in got.collect()} == want and any(want.values())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    assert evaluate.abort_after_error(df.limit(0), F.col("failed"), ("id",)).count() == 0
    assert not any(x.unrun for x in evaluate.abort_after_error(df, F.lit(False), ("id",)).collect())


@pytest.mark.parametrize("bins,few", [(1024, 4096), (4, 2)])
def test_exact_medians(spark, bins, few):
    r = random.Random(2)
    inf = float("inf")
    sets = {
        "even": [r.gauss(0, 1) for _ in range(500)], "odd": [r.expovariate(1) ** 9 for _ in range(501)], "ties": [float(r.randint(0, 3)) for _ in range(400)], "one": [7.5], "two": [1.0, 4.0],
        "none": [], "same": [2.5] * 99, "ends": [-inf, -1e308, 0.0, 1e308, inf, 3.0], "near": [1 + i * 2**-52 for i in range(50)],
    }
    rows = [(n, v) for n, vs in sets.items() for v in vs] + [("none", None), ("even", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, v double").repartition(3)
    got = evaluate.exact_medians(df, {n: F.when(F.col("kind") == n, F.col("v")) for n in sets}, bins, few)
    for n, vs in sets.items():
        assert got[n] == (pytest.approx(statistics.median(vs), rel=1e-15) if vs else None), n
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("nan"),)], "v double")
    assert math.isnan(evaluate.exact_medians(nan, {"v": F.col("v")}, bins, few)["v"])
    assert evaluate.exact_medians(nan.limit(0), {"v": F.col("v")})["v"] is None


# --- the chain ---

TEXT = "Component ID: {c}\nRevision: {r}\nDocument ID: D\n1. Data\nNominal depth: {v} mm.\n"


def test_a_slow_extractor_shows_in_its_stage(spark):
    pages = spark.createDataFrame([(f"{i}.pdf", 1, TEXT.format(c=f"Q{i}", r="A", v=i)) for i in range(6)], "source_file string, page_number int, text string")
    rows = readers.records(spark, [{"record_id": str(i), "component_id": f"Q{i}", "revision": "A", "attribute_name": "depth", "recorded_value": "1", "recorded_unit": "mm"} for i in range(6)])

    @F.pandas_udf("string")
    def slow(x: pd.Series) -> pd.Series:
        time.sleep(4)
        return x

    def extractor(questions):
        return audit.extract(questions.withColumn("passage", slow("passage")))

    times = audit.StageTimes()
    found = audit.chained(rows, pages, times)
    assert [r["stage"] for r in times.ran] == list(audit.STAGES) and [r["rows"] for r in times.ran] == [6] * 7
    plain = {r["stage"]: r["seconds"] for r in times.ran}
    times = audit.StageTimes()
    assert audit.audit(rows, pages, extractor=extractor, observe=times).count() == found.count() == 6
    slowed = {r["stage"]: r["seconds"] for r in times.ran}
    assert slowed["extract_measurement"] > plain["extract_measurement"] + 2 and slowed["judge_retrieval"] < slowed["extract_measurement"] - 2


# --- retrieval ---


def test_texts_that_name_components_of_many_corpora(spark):
    """Ids of every kind against the patterns themselves, in the corpus of the question and in no other."""
    r = random.Random(3)
    ids = ["A.mm/1", "a.b", "P-1", "p-1", "P-12", "1/mm", "µ7", "漢字", "(x)", "..", "nowhere-9", "mm 1", "", None]
    words = ["A.mm/1", "A mm 1", "a.b", "P-1", "P-12", "p-1x", "1/mm", "mm", "1", "µ7", "漢字", "(x)", "..", "mm 1"]
    texts = [(c, f"f{i}.pdf", p, " ".join(r.choice(words) for _ in range(r.randint(0, 6))) + r.choice(["", "\nRevision: A", "\nRev. B"])) for c in "uv" for i in range(8) for p in (1, 2)]
    pages = spark.createDataFrame(texts, "corpus_id string, source_file string, page_number int, text string")
    asked = [(f"{c}{i}{rev}{s}", c, x, rev, s) for c in "uvw" for i, x in enumerate(ids) for rev in ("A", "b", "", None) for s in (None, "f1", "nofile")]
    questions = spark.createDataFrame(asked, "qid string, corpus_id string, component string, revision string, stem string").withColumn("attribute", F.lit("depth"))
    full = pages.groupBy("corpus_id", "source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("full"))
    every = questions.filter("component != ''").join(full, "corpus_id")
    every = every.filter(rx.matches_component(F.col("full"), F.col("component"))).withColumn("own", F.coalesce(F.col("stem") == "f1", F.lit(False)))
    want = every.filter("not own or source_file = 'f1.pdf'").select("qid", "source_file", rx.matches_revision(F.col("full"), F.col("revision")).alias("has_revision"))
    got = retrieve.eligible(questions, pages).select("qid", "source_file", "has_revision")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    alone = retrieve.eligible(questions.filter("corpus_id = 'u'").drop("corpus_id"), pages.filter("corpus_id = 'u'").drop("corpus_id"))
    assert sorted(map(tuple, alone.collect())) == sorted(tuple(x) for x in want.collect() if x.qid.startswith("u"))
    assert retrieve.eligible(questions, pages.limit(0)).count() == 0 and retrieve.eligible(questions.limit(0), pages).count() == 0
