"""An audit that is kept up equals one made anew, whatever changes, and audits only what the changes can touch."""

import random

from pyarrow.fs import FileSelector

from attestor.plans import audit
from attestor.plans.incremental import KeptAudit, changes, manifest
from attestor.sources import readers

SHOWN = ("outcome", "exit_code", "retrieval_status", "document_filename", "supporting_passage", "proposed_value", "explanation")


def sheet(c, v, more=""):
    return f"Component ID: {c}\nRevision: A\nDocument ID: D-{c}\n1. Data\nNominal depth: {v} mm.\n{more}"


def anew(records, pages):
    done = audit.audit(records, pages)
    return {r.record_id: tuple(r[c] for c in SHOWN) for r in done.collect()}


def test_kept_audit_equals_one_made_anew(spark, tmp_path):
    r = random.Random(1)
    pages = {f"f{i}.pdf": [sheet(f"Q{i}", i)] for i in range(12)}
    rows = [{"record_id": f"r{i}", "component_id": f"Q{i}", "revision": "A", "attribute_name": "depth", "recorded_value": str(r.choice([i, 99])), "recorded_unit": "mm"} for i in range(14)]
    rows += [{**rows[0], "record_id": "twice"}, {**rows[1], "record_id": "refers", "document_reference": "f11"}, {**rows[2], "record_id": "signs", "component_id": "A.mm/1"}, {**rows[3], "record_id": "none", "recorded_value": None}]
    kept = KeptAudit(spark, f"file://{tmp_path}/kept")

    def frame():
        return spark.createDataFrame([(f, n + 1, t) for f, ts in pages.items() for n, t in enumerate(ts)], "source_file string, page_number int, text string")

    def step():
        own = readers.records(spark, rows)
        done = kept.refresh(own, frame())
        got = KeptAudit.record_key(own).join(done.results.select("record_key", *SHOWN), "record_key").collect()
        assert len(got) == len(rows) and {x.record_id: tuple(x[c] for c in SHOWN) for x in got} == anew(own, frame())
        return done.audited, {(x.source_file, x.kind) for x in done.changed.collect()}

    assert step() == (len(rows) - 1, {(f, "added") for f in pages})  # two records say the same
    pages["f4.pdf"] = [sheet("Q4", 77), "a second page"]  # A.mm/1 is audited as well, as the text has all of its runs now
    pages["new.pdf"] = [sheet("Q13", 13, "In place of Q5 and A.mm/1.")]  # one that was missing, and a second text for others
    del pages["f11.pdf"]  # also what a record of Q1 refers to
    rows += [{**rows[6], "record_id": "more", "recorded_value": "6.5"}, {**rows[6], "record_id": "unknown", "component_id": "Q99"}]
    del rows[0]
    assert step() == (8, {("f4.pdf", "changed"), ("new.pdf", "added"), ("f11.pdf", "removed")})


def test_manifests(spark):
    df = lambda rows: spark.createDataFrame(rows, "source_file string, page_number int, text string")
    a = manifest(df([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("c", 1, "z")]))
    b = manifest(df([("a", 2, "y"), ("a", 1, "x"), ("b", 1, ""), ("d", 1, "z")]))
    assert {tuple(r) for r in changes(a, b).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert changes(a, a).count() == 0


def test_what_is_kept_follows_the_questions(spark, tmp_path):
    from attestor.sources.shared import opened, shared_dir

    def folders():
        files, path = opened(shared_dir(spark))
        return {x.base_name for x in files.get_file_info(FileSelector(path)) if x.base_name.startswith("attestor-")}

    rows = [{"record_id": f"r{i}", "component_id": f"Q{i % 2}", "revision": "A", "attribute_name": "depth", "recorded_value": str(i // 2), "recorded_unit": "mm"} for i in range(40)]
    pages = spark.createDataFrame([(f"f{i}.pdf", 1, sheet(f"Q{i}", i)) for i in range(2)], "source_file string, page_number int, text string")
    own, before = readers.records(spark, rows + rows), folders()
    done = KeptAudit(spark, f"file://{tmp_path}/kept").refresh(own, pages)
    assert folders() == before  # what is stored on the way is gone
    assert sorted(p.name for p in (tmp_path / "kept/0").iterdir()) == ["answers", "asked", "changed", "manifest", "named", "records"]
    assert (done.audited, spark.read.parquet(f"file://{tmp_path}/kept/0/answers").count(), done.results.count()) == (40, 2, 40)
    unknown = readers.records(spark, [{**rows[0], "record_id": "other", "component_id": "Q9"}, {**rows[0], "record_id": "no value", "recorded_value": None}])
    assert {r.record_id: r.exit_code for r in done.of(unknown, only=("record_id", "exit_code")).collect()} == {"no value": "value_missing"}
    plan = KeptAudit._distinct(audit.normalize(own))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # a second one would take the records of a question apart again
