"""Audits that are kept up: a manifest of the texts' contents says what has changed, and only questions that this can touch are answered anew.

What is found for a record depends on what it asks and on the texts that name its component, not on its value. So answers are kept by
question, and a result is the answer, compared with the record. An answer is taken over unless its question is new, a text
that named its component has changed or gone, or a text that is new or changed names it now; and, where the question refers to a document,
unless a document of that name has come or gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import retrieve
from attestor.plans import audit as plan
from attestor.sources.shared import delete, grown, passing, stored, tidy


def manifest(pages: DataFrame) -> DataFrame:
    """source_file and sha256 of what its pages hold, in their order; pages are hashed where they are, and only hashes are brought together."""
    own = pages.select("source_file", F.struct("page_number", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("text").isNull().alias("none")).alias("p"))
    return own.groupBy("source_file").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("p"))), 256).alias("sha256"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_file and kind (added, changed, removed) of texts that two manifests don't agree on."""
    met = old.withColumnRenamed("sha256", "was").join(new.withColumnRenamed("sha256", "now"), "source_file", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return met.select("source_file", kind.alias("kind")).filter("kind is not null")


@dataclass
class Refreshed:
    records: DataFrame  # the distinct records, normalised, without ids
    answers: DataFrame  # qid and what is known of each question
    changed: DataFrame  # source_file, kind
    audited: int  # distinct records that are new or whose question was answered anew
    searched: int  # texts that were looked through for the answers

    @property
    def results(self) -> DataFrame:
        """record_key and the audit's columns, but for case_id and record_id: one row for each distinct record."""
        own = KeptAudit.keyed(self.records.withColumns(plan.shown_names()))
        return self._of(own.withColumns({"case_id": F.col("record_key"), "record_id": F.col("record_key")})).withColumnRenamed("case_id", "record_key").drop("record_id")

    def of(self, records: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
        """The results of these records, with their own ids; only names the columns that are made. Records that ask what the refresh
        wasn't asked are left out."""
        return self._of(plan.normalize(records), only)

    def _of(self, own: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
        met = plan.answered(plan.with_question(plan.validate(own)), self.answers)
        return plan.finish(plan.compare(met.filter("qid is null or retrieval_status is not null")), only)


class KeptAudit:
    """The folder at path: by the number of the refresh, the manifest of the texts, which of them name which component, the distinct
    records, what they ask and the answers. Results aren't kept but made of records and answers when they are read, as most of
    what they say is said by either. One refresh writes at a time, and one that fails midway counts for nothing.

    A record is known by what it says but for its own ids, or by record_key(), a hash of that; so equal records share a result.
    """

    NAMED, MANIFEST = "source_file string, component string", "source_file string, sha256 string"
    ASKED = "qid string, component string, records long, one long, two long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def record_key(records: DataFrame) -> DataFrame:
        """records, normalised, with record_key."""
        return KeptAudit.keyed(plan.normalize(records))

    @staticmethod
    def keyed(own: DataFrame) -> DataFrame:
        return own.withColumn("record_key", F.sha2(F.to_json(F.struct(*sorted(c for c in own.columns if c not in ("case_id", "record_id"))), {"ignoreNullFields": "false"}), 256))

    def _last(self) -> int:
        """The number of the last refresh that is whole, or -1. Answers are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path(self.path))] if files.exists(path(self.path)) else []
        return max((int(n) for n in names if n.isdigit() and files.exists(path(f"{self.path}/{n}/answers/_SUCCESS"))), default=-1)

    def _read(self, number: int, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{number}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def refresh(self, records: DataFrame, pages: DataFrame) -> Refreshed:
        with passing(self.spark):
            return self._refresh(records, pages)

    def _refresh(self, records: DataFrame, pages: DataFrame) -> Refreshed:
        last = self._last()
        here = f"{self.path}/{last + 1}"
        delete(self.spark, here)  # what a refresh that failed has left
        own = self._kept(self._distinct(plan.normalize(records)), f"{here}/records")
        asked = self._kept(self._asked(own), f"{here}/asked")
        manifest(pages).write.parquet(f"{here}/manifest")
        now = self._read(last + 1, "manifest", self.MANIFEST)
        changed = self._kept(changes(self._read(last, "manifest", self.MANIFEST), now), f"{here}/changed")
        old, was = self._read(last, "asked", self.ASKED), self._read(last, "named", self.NAMED)

        # Components that were asked for before are sought in texts that have changed, and new ones in all texts.
        components = asked.select("component").filter("component is not null").distinct()
        if last < 0:
            found = retrieve.named(components, pages, [])
        else:
            fresh = pages.join(grown(changed.filter("kind != 'removed'").select("source_file")), "source_file", "left_semi")
            new = stored(components.join(grown(old.select("component").distinct()), "component", "left_anti"), "components")
            none = new.isEmpty()
            found = retrieve.named(components if none else components.join(grown(new), "component", "left_anti"), fresh, [])
            found = found if none else found.unionByName(retrieve.named(new, pages, []))
        found = stored(found.select("source_file", "component").distinct(), "named")
        named = self._kept(was.join(grown(changed), "source_file", "left_anti").unionByName(found).distinct() if last >= 0 else found, f"{here}/named")

        again, rest = asked, None
        if last >= 0:
            touched = was.join(grown(changed), "source_file", "left_semi").select("component").unionByName(found.select("component")).distinct()
            stems = changed.filter("kind != 'changed'").select(retrieve.stem(F.col("source_file")).alias("stem")).distinct()
            stale = asked.join(grown(touched), "component", "left_semi").unionByName(asked.join(grown(stems), "stem", "left_semi")).unionByName(asked.join(grown(old), "qid", "left_anti"))
            stale = stored(stale.select("qid").distinct(), "stale")
            again, rest = stored(asked.join(grown(stale), "qid", "left_semi"), "again"), asked.join(grown(stale), "qid", "left_anti")
        names = stored(named.join(grown(again.select("component").distinct()), "component", "left_semi"), "names") if last >= 0 else named
        wanted = stored(names.select("source_file").distinct(), "wanted")
        audited = (again.agg(F.sum("records")).first()[0] or 0) + (self._new(own, rest, old, last) if rest else 0)
        tidy(self.spark)
        known = {} if retrieve.corpus_keys(again, pages) else {"names": names}
        answers = plan.answer(again.drop("records", "one", "two"), retrieve.baseline, plan.extract, lambda _, df: df, pages=pages.join(grown(wanted), "source_file", "left_semi"), existing=now.select("source_file"), **known)
        if rest:
            answers = self.spark.read.parquet(f"{self.path}/{last}/answers").join(grown(rest.select("qid")), "qid", "left_semi").unionByName(answers)
        answers = self._kept(answers, f"{here}/answers")
        return Refreshed(own, answers, changed, audited, wanted.count())

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _distinct(own: DataFrame) -> DataFrame:
        """Distinct records, without ids. They are dealt out and sorted by ranges of all that they say, so that one question's records lie
        together, where they take a byte or two each, and those of a common one are still spread."""
        said = (*plan.asked(own), *(c for c in own.columns if c not in ("case_id", "record_id", *plan.shown_names(), *plan.asked(own))))
        packed = own.select(F.struct(*said).alias("said"))  # as one column, of which Spark can't take constants away: so the ranges serve for both
        return packed.repartitionByRange("said").dropDuplicates().sortWithinPartitions("said").select("said.*")

    @staticmethod
    def _asked(own: DataFrame) -> DataFrame:
        """The questions, with the number of their distinct records and two sums of hashes that say whether these are still the same."""
        said = [*own.columns, *(F.isnull(c) for c in own.columns)]
        grouped = own.groupBy(*plan.asked(own)).agg(F.count(F.lit(1)).alias("records"), F.bit_xor(F.xxhash64(*said)).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), *said)).alias("two"))
        return plan.questions_of(grouped)

    def _new(self, own: DataFrame, asked: DataFrame, old: DataFrame, last: int) -> int:
        """How many records of these questions the last refresh didn't have. Records are compared only where a question's have changed."""
        same = ["qid", "records", "one", "two"]
        other = stored(asked.select(*same).join(grown(old.select(*same)), same, "left_anti").select("qid"), "other")
        if other.isEmpty():
            return 0
        had = self.spark.read.parquet(f"{self.path}/{last}/records")
        mine, had = (df.join(grown(other), plan.question_id(df) == F.col("qid"), "left_semi") for df in (own, had))
        return (mine.subtract(had.select(*mine.columns)) if set(mine.columns) == set(had.columns) else mine).count()
