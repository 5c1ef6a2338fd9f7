"""Settings: what a caller gives, else the session's configuration, else the environment, else a file of lines NAME=value, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Fields are read as attestor.<field> from the session, and as ATTESTOR_<FIELD> from the environment."""

    retriever: str = "baseline"
    extractor: str = "deterministic"
    corpus_id: str = "default"
    chunk_table: str = ""
    model_name: str = "hash"
    model_revision: str = "1"
    dimension: int = 64
    max_tokens: int = 240


def read_lines(path: str) -> dict[str, str]:
    """NAME=value lines; blanks and quotes around a value go, and lines that begin with # are passed over."""
    out = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, mark, value = line.strip().partition("=")
                if mark and not name.startswith("#"):
                    out[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out


def settings(spark: SparkSession | None = None, env_file: str = ".env", **given) -> Settings:
    """A file never overrides the environment. Unknown names in given are an error."""
    own, out = {**read_lines(env_file), **os.environ}, {}
    for f in fields(Settings):
        value = given.pop(f.name, None)
        if value is None and spark is not None:
            value = spark.conf.get(f"attestor.{f.name}", None)
        if value is None:
            value = own.get(f"ATTESTOR_{f.name.upper()}")
        if value is not None:
            out[f.name] = type(f.default)(value)
    if given:
        raise TypeError(f"unknown settings: {sorted(given)}")
    return Settings(**out)
