"""Rows by their place: running sums, numbered lines, .npy files, and artifacts whose vectors go by position."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.sources import npy, positions, store


def read(spark, path, **how):
    return {r.position: list(r.embedding) for r in npy.read(spark, str(path), **how).collect()}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "position long, embedding array<float>").repartition(3)


def test_running_sums(spark):
    r = random.Random(3)
    keys = list(range(1_000))
    r.shuffle(keys)
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else k % 5) for k in keys], "k long, n long").repartition(7)
    assert {x.k: x.position for x in positions.running(rows, ("k",)).collect()} == {k: k for k in keys}
    want, total = {}, 0
    for k in sorted(keys, reverse=True):
        want[k] = total
        total += 0 if k % 7 == 0 else k % 5
    summed = positions.running(rows, (F.desc("k"),), "before", F.col("n"))
    assert {x.k: x.before for x in summed.collect()} == want and summed.columns == ["k", "n", "before"]
    assert positions.running(rows.limit(0), ("k",)).collect() == []
    tied = positions.running(spark.createDataFrame([("a",)] * 5 + [(None,)] * 2, "k string"), ("k",)).collect()
    assert sorted(x.position for x in tied) == list(range(7)) and sorted(x.position for x in tied if x.k is None) == [0, 1]
    with pytest.raises(ValueError, match="already"):
        positions.running(rows.withColumnRenamed("n", "Position"), ("k",))


def test_lines_have_their_numbers(spark, tmp_path):
    """Over files, blocks and blank lines; files go by the number in their names."""
    texts = ["é" * (i % 50) for i in range(3_000)]
    order = ["part-00002-b.json", "part-99999-c.json", "part-100000-a.json"]
    for i, name in enumerate(order):
        (tmp_path / name).write_text("".join(json.dumps({"i": j, "text": texts[j]}, ensure_ascii=False) + ("\n\n" if j % 10 == 0 else "\n") for j in range(1_000 * i, 1_000 * (i + 1))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
        got = positions.lines(spark, str(tmp_path), "i long, text string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.position, r.i, r.text) for r in got) == [(j, j, texts[j]) for j in range(3_000)]
    (tmp_path / order[1]).write_text('{"i": 1}\n{"i": \n')
    with pytest.raises(ValueError, match="not JSON"):
        positions.lines(spark, str(tmp_path), "i long")


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<f2"])
def test_files_of_others(spark, tmp_path, kind):
    """Ranges of a few rows give what the whole file holds."""
    own = np.random.default_rng(1).standard_normal((257, 5)).astype(kind)
    np.save(tmp_path / "embeddings.npy", own)
    want = {i: row for i, row in enumerate(own.astype("<f4").tolist())}
    assert read(spark, tmp_path / "embeddings.npy", range_bytes=200) == want == read(spark, tmp_path, dimension=5)


def test_written_in_pieces(spark, tmp_path):
    own = np.random.default_rng(2).standard_normal((103, 4)).astype("<f4")
    rows = [(i, v) for i, v in enumerate(own.tolist())]
    files = {r.name: r for r in npy.write(vectors(spark, rows), str(tmp_path / "v"), 4, rows_per_file=10).collect()}
    assert len(files) == 11 and sum(r.rows for r in files.values()) == 103 and sorted(r.first for r in files.values()) == list(range(0, 103, 10))
    assert {p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".")} == set(files)
    assert np.array_equal(np.concatenate([np.load(tmp_path / "v" / n) for n in sorted(files)]), own)
    assert all(hashlib.sha256((tmp_path / "v" / n).read_bytes()).hexdigest() == r.sha256 for n, r in files.items())
    assert read(spark, tmp_path / "v", dimension=4) == dict(rows)
    assert npy.write(vectors(spark, rows[:3]), str(tmp_path / "v"), 4).count() == 1 and len(read(spark, tmp_path / "v")) == 3  # in place of the eleven
    assert npy.write(vectors(spark, []), str(tmp_path / "v"), 4).count() == 0 and read(spark, tmp_path / "v") == {}


@pytest.mark.parametrize("rows, says", [([(0, [1.0])], "dimension"), ([(0, None)], "dimension"), ([(0, [1.0, None])], "dimension"), ([(1, [1.0, 2.0])], "without gaps"), ([(0, [1.0, 2.0])] * 2, "without gaps"), ([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (3, [1.0, 2.0])], "without gaps")])
def test_rows_that_cant_be_written(spark, tmp_path, rows, says):
    with pytest.raises(Exception, match=says):
        npy.write(vectors(spark, rows), str(tmp_path / "v"), 2)


def test_files_that_cant_be_read(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((3, 4), "<f4"))
    with pytest.raises(ValueError, match="4 values, not 5"):
        npy.read(spark, str(tmp_path), 5)
    for name, own, says in (("narrow", np.zeros((2, 3), "<f4"), "3 values"), ("ints", np.zeros((2, 4), "<i4"), "no rows of floats"), ("flat", np.zeros(4, "<f4"), "no rows of floats"), ("turned", np.asfortranarray(np.zeros((2, 4), "<f4")), "by column")):
        np.save(tmp_path / f"{name}.npy", own)
        with pytest.raises(ValueError, match=says):
            npy.read(spark, str(tmp_path))
        (tmp_path / f"{name}.npy").unlink()
    whole = (tmp_path / "a.npy").read_bytes()
    for data, says in ((whole[:-4], "don't hold 3 rows"), (whole + b"x", "don't hold"), (b"text", "a.npy")):
        (tmp_path / "a.npy").write_bytes(data)
        with pytest.raises(ValueError, match=says):
            npy.read(spark, str(tmp_path))


def test_artifacts_by_position(spark, tmp_path):
    """What comes back is what the artifact by keys gives; lines or vectors that are gone or changed are found."""
    own = np.random.default_rng(3).standard_normal((90, 8))
    own = (own / np.linalg.norm(own, axis=1, keepdims=True)).tolist()
    rows = [("ü" if i % 3 else "b", f"c{i}", f"text\n{i}", *("x" for _ in store.REQUIRED[3:4]), 1, 0, i, 2, "h", "p", "A", own[i]) for i in range(90)]
    types = {c.split()[0]: c for c in store.SCHEMA.split(", ")}
    chunks = spark.createDataFrame(rows, ", ".join([*(types[c] for c in ("corpus_id", "chunk_id", "text")), *(types[c] for c in store.REQUIRED[3:]), types["embedding"]])).repartition(5)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.save_artifacts(chunks, a, "m", "1", 8, positional=True)
    store.save_artifacts(chunks, b, "m", "1", 8)
    held = lambda path: sorted((r.corpus_id, r.chunk_id, r.text, tuple(r.embedding), r.end_char, r.model_name) for r in store.load_artifacts(spark, path, 8).collect())
    assert held(a) == held(b) and len(held(a)) == 90
    with pytest.raises(ValueError, match="dimension"):
        store.load_artifacts(spark, a, 4)
    manifest = tmp_path / "a" / "manifest.json"
    described = json.loads(manifest.read_text())
    files = described["files"]["embeddings"]
    vectors_of = npy.read(spark, f"{a}/{store.VECTORS}").filter("position < 89")
    kept = {r.name: r.sha256 for r in npy.write(vectors_of, f"{tmp_path}/fewer", 8).collect()}
    (name,) = kept
    (tmp_path / "a" / "embeddings" / name).write_bytes((tmp_path / "fewer" / name).read_bytes())
    for side in (tmp_path / "a" / "embeddings").glob(".*.crc"):
        side.unlink()
    with pytest.raises(ValueError, match="aren't those of the manifest"):
        store.load_artifacts(spark, a, 8)
    assert set(files) == {name}
    described["files"]["embeddings"] = kept
    manifest.write_text(json.dumps(described))
    for side in (tmp_path / "a").glob(".*.crc"):
        side.unlink()
    with pytest.raises(ValueError, match="1 stand alone"):
        store.load_artifacts(spark, a, 8)
