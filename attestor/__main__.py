"""python -m attestor COMMAND: generate, audit, retrieve, extract-pdf, chunk, ingest, index, evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import chunking, evaluate, report, retrieve
from attestor.plans import audit as plan
from attestor.sources import fixtures, readers, settings, store


def _embedded(chunks: DataFrame, own: settings.Settings) -> DataFrame:
    return chunking.embed(chunks, own.dimension).withColumns({"model_name": F.lit(own.model_name), "model_revision": F.lit(own.model_revision), "created_at": F.current_timestamp()})


def _audited(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> DataFrame:
    return plan.audit(readers.read_records(spark, a.records), readers.read_pages(spark, a.pages), own.retriever)


def _audit(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    readers.write_results(_audited(spark, a, own), a.out)
    return 0


def _retrieve(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    _, questions = plan.ask(plan.validate(plan.normalize(readers.read_records(spark, a.records))))
    readers.write_results(retrieve.strategy(own.retriever)(questions, pages=readers.read_pages(spark, a.pages)), a.out)
    return 0


def _extract(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    pages, errors = readers.read_pdf(spark, a.pages, a.out.rstrip("/") + "__staged")
    readers.write_pages(pages, a.out)
    bad = errors.orderBy("source_file").limit(100).collect()
    for r in bad:
        print(f"{r.source_file}: {r.error}", file=sys.stderr)
    return int(bool(bad))


def _chunk(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    rows = chunking.chunks(readers.read_pages(spark, a.pages, strict=True), own.corpus_id, own.max_tokens, strict=True)
    store.save_artifacts(rows if a.dry_run else _embedded(rows, own), a.out, own.model_name, own.model_revision, own.dimension, vectors=not a.dry_run)
    return 0


def _ingest(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    rows = store.load_artifacts(spark, a.pages, own.dimension).withColumn("created_at", F.current_timestamp())
    print(store.ChunkStore(spark, a.out).upsert(rows))
    return 0


def _index(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    pages = readers.read_corpora(spark, a.pages) if a.by_folder else readers.read_pages(spark, a.pages).withColumn("corpus_id", F.lit(own.corpus_id))
    rows, rejected = store.corpora(pages, own.max_tokens)
    print(store.ChunkStore(spark, a.out).upsert(_embedded(rows, own)))
    for r in rejected.orderBy("corpus_id").limit(100).collect():
        print(f"left out {r.corpus_id}: {r.reason}", file=sys.stderr)
    return 0


def _evaluate(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    rows = evaluate.suite(evaluate.cases(_audited(spark, a, own), readers.read_expected(spark, a.expected), readers.read_pages(spark, a.pages)), a.suite).cache()
    print(evaluate.markdown(evaluate.summary(rows).first().asDict()))
    readers.write_results(rows, a.out)
    report.write({"summary": evaluate.summary(rows), "stages": report.stage_table(rows), "outcomes": report.outcome_table(rows), "cases": report.case_table(rows)}, a.out.rstrip("/") + "__report")
    return int(not evaluate.failures(rows, tuple(a.tolerate)).isEmpty())


def _generate(spark: SparkSession, a: argparse.Namespace, own: settings.Settings) -> int:
    fixtures.write_cases(spark, a.n, a.out)
    return 0


COMMANDS = {"generate": _generate, "audit": _audit, "retrieve": _retrieve, "extract-pdf": _extract, "chunk": _chunk, "ingest": _ingest, "index": _index, "evaluate": _evaluate}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m attestor")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--records", help="JSON records")
    p.add_argument("--pages", help="JSON pages of texts; PDF files, or an artifact's folder, where the command reads these")
    p.add_argument("--expected", help="JSON expected answers")
    p.add_argument("--out", required=True)
    p.add_argument("--suite", default="all", choices=sorted(evaluate.SUITES))
    p.add_argument("--tolerate", nargs="*", default=[], help="cases that are known to fail")
    p.add_argument("--n", type=int, default=16, help="cases to make")
    p.add_argument("--dry-run", action="store_true", help="no vectors")
    p.add_argument("--by-folder", action="store_true", help="a corpus for each folder")
    p.add_argument("--retriever")
    p.add_argument("--corpus-id")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    return COMMANDS[a.command](spark, a, settings.settings(spark, retriever=a.retriever, corpus_id=a.corpus_id))


if __name__ == "__main__":
    sys.exit(main())
