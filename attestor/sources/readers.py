"""Scans of records and page texts, and sinks of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.plans.audit import FIELDS

#: All text, so numbers keep their digits and a reference may be a string or an object.
RECORD = ", ".join(f"{f} string" for f in FIELDS)
DOCUMENT = "source_file string, pages array<struct<page_number:int,text:string>>"


#: Files that hold one JSON object a line; others hold one each. A line is found by its file and the block that it begins in.
LINES, OBJECTS, BY_NAME = "lines", "objects", "by name"
_LINED = r"^part-|\.jsonl$|\.ndjson$"


def scan(spark: SparkSession, path: str, schema: str, layout: str = BY_NAME) -> DataFrame:
    """(file, block, text, o, error) of the JSON objects of files. layout says how files are laid out: lines, which Spark splits
    and which so may be of any size, objects, or by name: part-*, *.jsonl and *.ndjson are lines.

    o is the object by the schema, error what is wrong with a line or file that isn't one; each is judged by itself, and
    one that is broken takes no other along. Blank lines and empty files are left out. file and block, the offset at which the part of
    the file begins that a task reads, order what is scanned.
    """
    if layout not in (LINES, OBJECTS, BY_NAME):
        raise ValueError(f"no layout is named {layout!r}")

    def texts(whole: bool) -> DataFrame:
        meta = F.col("_metadata")
        own = spark.read.text(path, wholetext=whole)
        if layout == BY_NAME:
            lined = F.rlike(meta["file_name"], F.lit(_LINED))
            own = own.filter(~lined if whole else lined)
        return own.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("text"))

    rows = texts(layout == OBJECTS) if layout != BY_NAME else texts(False).unionByName(texts(True))
    rows = rows.filter(F.trim("text") != "") if layout == LINES else rows.filter((F.trim("text") != "") | ~F.rlike(F.element_at(F.split("file", "/"), -1), F.lit(_LINED)))
    # a parser stops behind the first value; as the one element of an array, text with more behind it is broken
    parsed = F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))
    at = lambda i: F.try_variant_get(parsed, f"$[{i}]", "variant")
    error = F.when(parsed.isNull() | at(0).isNull() | at(1).isNotNull(), "not JSON").when(~F.startswith(F.schema_of_variant(at(0)), F.lit("OBJECT")), "not an object")
    rows = rows.withColumn("error", error)
    return rows.withColumn("o", F.when(F.col("error").isNull(), F.from_json("text", schema)))


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """The objects; what isn't one is left out, or fails the job if strict."""
    fails = F.raise_error(F.concat("error", F.lit(": "), "file")).cast("boolean")
    return rows.filter(F.when(F.col("error").isNotNull(), fails if strict else F.lit(False)).otherwise(F.lit(True)))


def errors(rows: DataFrame) -> DataFrame:
    """(file, block, text, error) of what a scan couldn't read."""
    return rows.filter("error is not null").select("file", "block", "text", "error")


def read_records(spark: SparkSession, path: str, layout: str = BY_NAME) -> DataFrame:
    return _checked(scan(spark, path, RECORD, layout), True).select("o.*")


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """From dictionaries; values become text, as a JSON reader would have them."""
    import json

    text = lambda v: None if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)
    return spark.createDataFrame([tuple(text(r.get(f)) for f in FIELDS) for r in rows], RECORD)


def _pages(rows: DataFrame, *more: Column) -> DataFrame:
    docs = rows.filter("o.source_file is not null and size(o.pages) > 0").select(*more, "o.source_file", F.explode("o.pages").alias("p"))
    return docs.select(*(c for c in docs.columns if c != "p"), "p.page_number", "p.text")


def read_pages(spark: SparkSession, path: str, strict: bool = False, layout: str = BY_NAME) -> DataFrame:
    """(source_file, page_number, text). What can't be read is passed over (pages_and_errors has it), or fails the scan if strict; so does an empty folder then. Texts without pages are left out."""
    docs = _checked(scan(spark, path, DOCUMENT, layout), strict)
    if strict and docs.filter("o.source_file is not null").isEmpty():
        raise ValueError(f"no documents in {path}")
    return _pages(docs)


def pages_and_errors(spark: SparkSession, path: str, layout: str = BY_NAME) -> tuple[DataFrame, DataFrame]:
    """The pages with file and block, by which they can be put into the order of their files, and what wasn't read: errors(), and objects without a source file or pages."""
    rows = scan(spark, path, DOCUMENT, layout)
    why = F.coalesce("error", F.when(F.col("o.source_file").isNull(), "no source_file").when(~F.coalesce(F.size("o.pages") > 0, F.lit(False)), "no pages"))
    rows = rows.withColumn("error", why)
    return _pages(_checked(rows, False), F.col("file"), F.col("block")), errors(rows)


def read_corpora(spark: SparkSession, path: str, layout: str = BY_NAME) -> DataFrame:
    """Pages of the folders below path; each folder's name is its corpus_id."""
    return _pages(_checked(scan(spark, f"{path.rstrip('/')}/*/", DOCUMENT, layout), False), F.element_at(F.split("file", "/"), -2).alias("corpus_id"))


#: The fields of an expected answer.
EXPECTED = (
    "case_id string, category string, description string, expected_outcome string, expected_correction struct<value:double,unit:string>, "
    "expected_evidence struct<document_filename:string,page_number:int,supporting_passage:string>, limitation_note string"
)


def read_expected(spark: SparkSession, path: str, layout: str = BY_NAME) -> DataFrame:
    """Expected answers, one a case, with their structs spread over columns."""
    rows = _checked(scan(spark, path, EXPECTED, layout), True).select("o.*")
    return rows.select("case_id", "expected_outcome", F.col("expected_correction.value").alias("expected_value"), F.col("expected_correction.unit").alias("expected_unit"), F.col("expected_evidence.document_filename").alias("expected_file"), F.col("expected_evidence.page_number").alias("expected_page"), F.col("expected_evidence.supporting_passage").alias("expected_passage"))


def write_pages(pages: DataFrame, path: str) -> None:
    """JSON objects of texts with their pages, one a line."""
    pages.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages")).write.mode("overwrite").json(path)


def pypdf_pages(content: bytes) -> list[str]:
    """The text of each page, by pypdf."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def read_pdf(spark: SparkSession, path: str, staged: str, read: Callable[[bytes], list[str]] = pypdf_pages) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of PDF files. A file without pages or with a blank page is an error as a whole, and others go on.
    Each file is read once: all rows are written to the folder staged, and both tables are read from there. read turns a
    file's bytes into the texts of its pages."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                file = name.rsplit("/", 1)[-1]
                try:
                    texts = read(content)
                    if not texts or any(not t.strip() for t in texts):
                        raise ValueError("no pages, or a blank one")
                    out += [(file, i + 1, t, None) for i, t in enumerate(texts)]
                except Exception as e:  # noqa: BLE001  the error channel
                    out.append((file, None, None, str(e)))
            yield pd.DataFrame(out, columns=["source_file", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    schema = "source_file string, page_number int, text string, error string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for at in files.globStatus(where) or [] for f in (files.listStatus(at.getPath()) if at.isDirectory() else [at])]
    empty = [(f.getPath().getName(), None, None, "the file is empty") for f in found if f.isFile() and not f.getLen()]  # Spark passes over these
    spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(schema).parquet(staged).union(spark.createDataFrame(empty, schema))
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("source_file", "error")


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines; characters stay as they are."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
