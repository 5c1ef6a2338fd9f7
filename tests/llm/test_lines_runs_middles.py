"""Line dedup, period runs and fill-in-the-middle against brute force, and on odd rows."""

import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from attestor.llm import fill_middle, line_dedup, period_runs
from attestor.llm.queries import planted

SCHEMA = "doc_id long, text string, id long, n long, key string, lines string, runs string, of long, h string, form string"  # the last ones clash with names used inside
CLASH = (1, 2, "x", "y", "z", 3, "h", "f")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    return [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (None, "a line that has no document id"), (9005, "wörter und " * 4000)]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})


def brute_lines(rows, min_chars=20, min_docs=3):
    held: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    top = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in top or i == top[key(x)]]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(str, out))


def test_lines(spark, odd):
    r = random.Random(1)
    pool = ["This line stands in many documents.", "\tthis LINE stands in many documents. \r", "short", "", "Ünïcode LINE with twenty é", "exactly twenty chars", "only nineteen chars", "a second line that many documents have"]
    rows = [(i, "\n".join(r.choice([*pool, f"a line of its own, number {r.random()}"]) for _ in range(r.randint(1, 9)))) for i in range(80)]
    rows += [rows[3], rows[3], (5, "another text of document five\n" + pool[0]), *odd, (None, pool[0]), (None, pool[0] + "\n" + pool[7])]
    got = line_dedup.drop_shared_lines(frame(spark, rows))
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.kept)) for x in got.collect()) == brute_lines(rows)
    got = line_dedup.drop_shared_lines(frame(spark, rows), min_chars=1, min_docs=2)
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.kept)) for x in got.collect()) == brute_lines(rows, 1, 2)
    assert line_dedup.drop_shared_lines(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_one_document_and_of_all(spark):
    """A line that repeats within two documents isn't in three; one in all of them stays in the largest only; a very long text and a very long line."""
    own, all_ = "this line repeats in two documents", "this line stands in each document"
    rows = [(1, "\n".join([own] * 50)), (2, f"{own}\n{own}\n{all_}"), (3, all_), (4, f"x\n{all_}\n{all_}"), (7, f"{all_}\n{all_}"), (6, f"{all_}\n" * 40_000), (5, "ab " * 200_000 + "\n" + all_)]
    got = {x.doc_id: x for x in line_dedup.drop_shared_lines(frame(spark, rows)).collect()}
    assert [(got[i].n_lines, got[i].n_dropped) for i in range(1, 8)] == [(50, 0), (3, 1), (1, 1), (3, 2), (2, 1), (40_001, 40_000), (2, 0)]


def brute_runs(words, min_length=24, min_exp=3):
    found = []
    for q in range(1, len(words) // min_exp + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exp * q):
                part = words[i : j + q]
                if not any(all(part[x] == part[x + d] for x in range(len(part) - d)) for d in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    found.sort(key=lambda x: (x[0], x[2]))
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    return found, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(r, n):
    words = [r.choice("abcdefgé") * r.randint(1, 2) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        q, times, at = r.randint(1, 12), r.randint(2, 30), r.randrange(n + 1)
        words[at:at] = (words[:q] or ["x"]) * times
    return words


@pytest.mark.parametrize("whole,lags,block", [(1 << 16, 2048, 1 << 20), (0, 7, 500), (200, 1, 64)])
def test_runs(spark, odd, monkeypatch, whole, lags, block):
    monkeypatch.setattr(period_runs, "BLOCK", block)
    r = random.Random(2)
    rows = [(i, r.choice([" ", "\n\t", "  "]).join(periodic(r, r.randint(0, 60)))) for i in range(60)]
    rows += [rows[0], rows[0], (7, "a " * 500), (8, "a b " * 30 + "a a " * 30), *odd[:5], (9005, "wörter und " * 300)]
    for exp, least in ((3, 24), (2, 4)):
        want = []
        for i, t in rows:
            words = WORD.findall(t or "")
            runs, best, text = brute_runs(words, least, exp)
            want.append(str((i, len(words), runs, best, text)))
        got = period_runs.period_runs(frame(spark, rows), min_length=least, min_exp=exp, whole_bytes=whole, lags=lags).collect()
        assert sorted(str((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.strongest and tuple(x.strongest), x.collapsed)) for x in got) == sorted(want)
    assert period_runs.period_runs(frame(spark, rows).limit(0), whole_bytes=whole).count() == 0


def test_runs_of_long_texts(spark):
    """A long text is dealt out by lags: its runs are those that one task finds, of short and of long periods."""
    r = random.Random(3)
    words = [str(r.randrange(400)) for _ in range(9_000)]
    words[100:100] = words[5000:8000] * 4 + ["x"] * 3_000
    text = " ".join(words)
    long, whole = (period_runs.period_runs(frame(spark, [(1, text), (2, text)]), whole_bytes=b, lags=500).orderBy("doc_id").collect() for b in (1 << 10, 1 << 30))
    assert long == whole and {x.period for x in long[0].runs} == {1, 3000} and long[0].runs == long[1].runs


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "a b"), (11, None)]
    import zlib

    def want(i, t):
        h = zlib.crc32(str(i).encode())
        words, g = WORD.findall(t or ""), h // 10
        if i is None or h % 10 or not words:
            return t
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        return " ".join(words[:a] + [words[a + (j - a) % p] for j in range(a, len(words))])

    got = planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((x.doc_id, x.text)) for x in got) == sorted(str((i, want(i, t))) for i, t in rows)
    assert sum(t != want(i, t) for i, t in rows) > 10


def brute_middle(i, t, seed="1"):
    t = t or ""
    digits = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t)
    p, m, s = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middles(spark, odd):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab<PSM> \né😀́") for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(500, "has <M> in it"), (501, "<" * 50), (502, "<P" * 30), (503, "x" * 300_000), rows[0], rows[0], *odd]
    got = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    want = [brute_middle(i, t) for i, t in rows]
    assert sorted(str((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output)) for x in got) == sorted(map(str, want))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(x.doc_id), x.output_sha256, x.restored_sha256) for x in got) == sorted((str(i), digest(w[5]), digest(t)) for (i, t), w in zip(rows, want, strict=True))
    assert sorted((str(x.doc_id), x.back) for x in got) == sorted((str(i), t or "") for i, t in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, rows).limit(0)).count() == 0


def test_middles_of_words(spark):
    """Other units, marks, seeds and shares; cuts fall at ends of units only, and each text comes back."""
    rows = [(i, " ".join(f"wört{j}" for j in range(i % 40))) for i in range(300)]
    marks = fill_middle.Marks("[pre]", "[suf]", "[mid]")
    got = fill_middle.fill_in_middle(frame(spark, rows), unit=fill_middle.WORDS, seed="other", marks=marks, plain_percent=0, spm_percent=100).collect()
    for x in got:
        text = dict(rows)[x.doc_id]
        ends = {0, *(m.end() for m in regex.finditer(fill_middle.WORDS, text))}
        assert x.n == len(text.split()) and x.form == ("spm" if text else "plain")
        assert not text or {x.prefix_chars, x.prefix_chars + x.middle_chars} <= ends
        assert fill_middle.rebuilt(x.output, x.form, marks) == text
    for bad in (fill_middle.Marks("<P>", "<P>", "<M>"), fill_middle.Marks("ab", "bc", "x"), fill_middle.Marks("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(frame(spark, rows), marks=bad)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(frame(spark, rows), unit="x*")
