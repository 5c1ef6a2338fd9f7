"""A ledger of a model's answers in the shared folder, so that no question is put to a provider twice.

An answer is a file of its own before anything uses it. A task that is run again, on this machine or another, finds what the
one before it was told and goes on from there; results of a plan are read from the ledger and hold no calls at all. Once a
job is through, its answers are one more part of the table, and their files go.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.shared import delete, opened

ANSWER = "key string, model string, text string, failed string, ms double, asked int, given int"
_FIELDS = [f.split()[0] for f in ANSWER.split(", ")]


def key(prompt: Column, model: str) -> Column:
    """What a question is known by: the model and each letter of the prompt."""
    return F.when(prompt.isNotNull(), F.sha2(F.concat(F.lit(f"{model}\n"), prompt), 256))


class _Notes:
    """The answers of a job that isn't through, one file each. A claim keeps two attempts of a task from asking at the same time;
    a claim that is older than patience seconds is a dead task's."""

    def __init__(self, uri: str, patience: float):
        self.files, self.path = opened(uri)
        self.patience = patience

    def _at(self, key: str, end: str = "json") -> str:
        return f"{self.path}/{key[:2]}/{key}.{end}"

    def read(self, key: str) -> dict | None:
        if self.files.get_file_info(self._at(key)).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(self._at(key)) as f:
            return json.loads(f.read())

    def write(self, key: str, row: dict) -> None:
        part = self._at(key, f"{uuid.uuid4().hex}.part")
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(row, ensure_ascii=False).encode())
        self.files.move(part, self._at(key))  # an answer is there as a whole or not at all

    def claim(self, key: str) -> bool:
        """Whether the caller may ask. Only file systems of this machine or mounted on it can tell; others say yes."""
        self.files.create_dir(f"{self.path}/{key[:2]}", recursive=True)
        if not isinstance(self.files, fs.LocalFileSystem):
            return True
        mark = self._at(key, "claim")
        try:
            os.close(os.open(mark, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            try:
                if time.time() - os.stat(mark).st_mtime < self.patience:
                    return False
                os.utime(mark)
                return True
            except FileNotFoundError:
                return False

    def once(self, key: str, ask: Callable[[], dict]) -> dict:
        while True:
            if (row := self.read(key)) is not None:
                return row
            if self.claim(key):
                row = ask()
                self.write(key, row)
                return row
            time.sleep(min(0.2, self.patience / 4))


class CallLedger:
    """The folder at path. One job writes to it at a time. A provider's failure is an answer too; with again=True what
    failed is asked anew by the next job, and the last answer counts."""

    def __init__(self, spark: SparkSession, path: str, again: bool = False, patience: float = 120.0):
        self.spark, self.path, self.again, self.patience = spark, path.rstrip("/"), again, patience

    def read(self) -> DataFrame:
        """Every answer that was ever given, with its time."""
        schema = f"{ANSWER}, at timestamp"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/answers")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def answers(self) -> DataFrame:
        """One row for each question: key, model, text, failed, ms, asked, given; the last answer counts."""
        return self.read().groupBy("key").agg(F.max_by(F.struct(*_FIELDS[1:]), "at").alias("a")).select("key", "a.*")

    def ask(self, prompts: DataFrame, call: Callable[[str], dict], model: str) -> None:
        """Puts each prompt (key, prompt) that has no answer yet to call, which gives text, failed, ms, asked and given."""
        done = self.answers()
        wanted = prompts.filter("key is not null").select("key", "prompt").dropDuplicates(["key"]).join(done.filter("failed is null") if self.again else done, "key", "left_anti")
        notes, patience = f"{self.path}/open", self.patience

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = _Notes(notes, patience)
            for frame in frames:
                rows = [{**held.once(k, lambda p=p: call(p)), "key": k, "model": model} for k, p in zip(frame["key"], frame["prompt"], strict=True)]
                yield pd.DataFrame(rows, columns=_FIELDS).astype({"asked": "Int32", "given": "Int32", "ms": "float64"})

        wanted.repartition("key").mapInPandas(run, ANSWER).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/answers")
        delete(self.spark, notes)
