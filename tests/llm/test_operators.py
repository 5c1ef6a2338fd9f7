"""Edge cases and brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import bpe, decontaminate, exact_dedup, near_dedup, secrets, substring_dedup, token_counts, toxicity, url_filter, warc, words
from attestor.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, id long, n long, sha string"  # the last three clash with names used inside
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    shared = [" ".join(r.choice(base) for _ in range(40)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = " ".join(r.choice(base) for _ in range(r.randint(0, 120)))
        if r.random() < 0.5:
            t += "\n" + r.choice(shared) + "\t" + r.choice(base)
        out.append(t)
        if r.random() < 0.3:
            w = t.split(" ")
            w[r.randrange(len(w))] = "Changed"
            out.append(" ".join(w))
        if r.random() < 0.2:
            out.append(t.upper() if t.isascii() else t)
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(i, t) for i, t in enumerate(texts())]
    return own + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "a " * 30000), (None, own[0][1]), own[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact(docs, none, rows, monkeypatch):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    for hits in (exact_dedup.HOT_HITS, 2):  # the second makes every copied text hot
        monkeypatch.setattr(exact_dedup, "HOT_HITS", hits)
        got = exact_dedup.exact_groups(docs).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        want = sorted((str(i), str(max((x for x in groups[low(t)] if x is not None), default=None)), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        kept = exact_dedup.exact_dedup(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_smallest(docs, rows, monkeypatch):
    """The smallest identifier stays, null last of all; also where copied texts are hot."""
    best: dict = {}
    for i, t in rows:
        best[low(t)] = min((x for x in (i, best.get(low(t))) if x is not None), default=None)
    for hits in (exact_dedup.HOT_HITS, 2):
        monkeypatch.setattr(exact_dedup, "HOT_HITS", hits)
        got = exact_dedup.exact_groups(docs, keep="smallest").collect()
        assert sorted((str(r.doc_id), str(r.keep_id)) for r in got) == sorted((str(i), str(best[low(t)])) for i, t in rows)
        assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(map(str, best.values()))
        assert sorted(str(r.doc_id) for r in exact_dedup.exact_dedup(docs, keep="smallest").collect()) == sorted(map(str, best.values()))
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, keep="first")


def test_secrets(spark):
    t = ["token=secret=abcdefghij x", 'é password : "0123456789abcdef0123456789abcdef"', None, "", "AKIA" + "B" * 12 + " AKIA" + "B" * 11, "api_key=short: longervalue1 apikey=longervalue1", "f" * 32 + "g" + "e" * 31]

    def brute(t):
        out = []
        for k, (p, g, n) in enumerate(((secrets.RULES[0].pattern, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32))):
            out += [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if len(m[g]) >= n]
        return ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(out))

    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)] + [(0, t[0]), (None, t[1])], "path long, text string")
    ledger = secrets.BlobLedger(spark, scratch(spark, "t"))
    for _ in range(2):
        got = ledger.scan(df).withColumn("s", secrets.spans_text(F.col("spans"))).collect()
        assert sorted((str(r.path), r.s) for r in got) == sorted([*((str(i), brute(x)) for i, x in enumerate(t)), ("0", brute(t[0])), ("None", brute(t[1]))])
    assert ledger.read().count() == len({x or "" for x in t})  # the second scan found nothing unseen
    assert ledger.scan(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "é " + "token=abcdefgh x api_key=short " * 3000, "x", "y")], "path long, text string, spans string, blob string")
    assert secrets.BlobLedger(spark, scratch(spark, "t")).scan(odd).select(secrets.spans_text(F.col("spans"))).first()[0] == brute("é " + "token=abcdefgh x api_key=short " * 3000)
    newer = (*secrets.RULES, secrets.Rule("pin", r"pin=(\d+)", 1, 4))
    assert ledger.scan(df, rules=newer).count() == df.count() and ledger.read().count() == 2 * len({x or "" for x in t})  # a new version of the rules scans each blob again


def test_toxicity(spark, none):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        data.append((i, " ".join(r.choice(["zorkan", "zorkel", "zorkix"]) if bad and r.random() < 0.1 else r.choice(words) for _ in range(80))))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).join(docs.select("doc_id", toxicity.held_out("doc_id").alias("out")), "doc_id").collect()}
    held = [(i, y) for i, y in labels if got[i].out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held) > 100
    assert got[900].score == got[901].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_kneser_ney():
    """Probabilities of each context sum to one, ratios add up to the log-likelihoods, and unseen expressions count for neither class."""
    r = random.Random(6)
    counts = [("".join(r.choice("abcd") for _ in range(r.randint(1, 6))), r.randint(0, 4), r.randint(0, 3)) for _ in range(80)]
    counts = [(w, a, b) for w, (a, b) in {w: (a, b) for w, a, b in counts}.items()]
    for order in (1, 3, 5):
        model, ratios = toxicity.KneserNey(counts, order), toxicity.fit_ratios(counts, order)
        letters = sorted({g[-1] for g in model.seen})
        for k in (0, 1):
            for h in ["", "z", *model.sums[0], *model.sums[1], *model.total]:
                if len(h) < order:
                    assert abs(sum(model.probability(k, h + a) for a in [*letters, "?"]) - 1) < 1e-9
        for w in ("abc", "dd", "abcdab", "zzz", ""):
            text = "^" + w + "$"
            grams = [text[max(0, i + 1 - order) : i + 1] for i in range(1, len(text))]
            want = sum(np.log(model.probability(1, g)) - np.log(model.probability(0, g)) for g in grams)
            assert abs(ratios.word(w) - want) < 1e-9


def test_score_against_plain_dictionaries(spark):
    """The whole formula by dictionaries: log-likelihoods of both classes word by word, their difference by length, the excess over the baseline, the logistic curve."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(150)]
    data = [(i, " ".join(r.choice(["zorkan", "zorkel"]) if i % 4 == 0 and r.random() < 0.1 else r.choice(words) for _ in range(60)), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(data + [(900, None, 0), (901, "?!", 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    out = {x.doc_id for x in docs.filter(toxicity.held_out("doc_id")).collect()}
    counts: dict = {}
    for i, t, y in data:
        if i not in out:
            for w in re.findall("[a-z]+", t):
                counts.setdefault(w, [0, 0])[y] += 1
    plain = toxicity.KneserNey([(w, *n) for w, n in counts.items()])

    def ratio(w):
        text = f"^{w}$"
        grams = [text[max(0, i + 1 - toxicity.ORDER) : i + 1] for i in range(1, len(text))]
        return sum(np.log(plain.probability(1, g)) for g in grams) - sum(np.log(plain.probability(0, g)) for g in grams)

    usual = sorted(x for w, n in counts.items() for x in [ratio(w)] * n[0])
    baseline = next(x for i, x in enumerate(usual, 1) if i >= toxicity.BASELINE * len(usual))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    for i, t, _ in [*data, (900, "", 0), (901, "", 0)]:
        own = [ratio(w) for w in re.findall("[a-z]+", t)]
        mean = sum(own) / len(own) if own else 0.0
        excess = sum(max(x - baseline - toxicity.MARGIN, 0.0) for x in own) / len(own) if own else 0.0
        want = 1 / (1 + np.exp(-(mean + model.slope * np.log(1e-3 + excess) + model.intercept)))
        assert abs(got[i] - want) < 1e-6
    none = toxicity.fit(docs.drop("toxic"), docs.drop("text").limit(0))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_edges(spark):
    """Null ids, repeated rows, columns with clashing names, ties of labels, a very long text."""
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 5, "x", 1) for i in range(60)] + [(None, "bad bad", "x", 1), (3, "bad " * 5, "x", 1), (99, "good " * 50_000, "x", 1)], "doc_id long, text string, keep string, score long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (3, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and [r.predicted for r in got if r.doc_id is None] == [1] and len({r.score for r in got if r.doc_id == 3}) == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.text.split()[0] for r in kept.collect()} == {"good"} and {r.keep for r in kept.collect()} == {"x"}


def test_split_benchmark_scores_as_whole(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 3))) for _ in range(120)]
    own = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, own(r.randint(8, 40))) for i in range(60)]
    items += [(100 + i, items[i][1]) for i in range(20)] + [(200, ""), (201, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, own(30) + " " + items[i][1] + " " + own(30)) for i in range(40)], "doc_id long, text string")
    found = lambda: sorted((x.doc_id, x.item_id, round(x.score, 9), x.question_overlap, x.answer_overlap) for x in decontaminate.contaminated(docs, benchmark).collect())
    weights = lambda: {i: sorted((w, round(x, 9)) for w, k in index.terms.items() for at, x in index.posts[k] if at == n) for index in decontaminate.indexes(benchmark) for n, i in enumerate(index.items)}
    whole, by_item = found(), weights()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 25)
    assert len(list(decontaminate.indexes(benchmark))) > 2
    assert weights() == by_item and len(by_item) == 80
    assert found() == whole and len(whole) >= 60
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 500)
    assert found() == whole
    odd = docs.union(spark.createDataFrame([(None, items[0][1]), (None, items[0][1]), (1, None)], docs.schema)).withColumn("keep", F.lit("x")).withColumn("item_id", F.lit(1))
    twice = benchmark.union(benchmark.limit(1)).withColumn("doc_id", F.lit(3)).withColumn("item_id", F.col("item_id").cast("decimal(12,0)"))
    assert decontaminate.contaminated(odd, twice).filter("doc_id is null").count() == 2 * (decontaminate.contaminated(docs.limit(1), twice).count())
    kept = decontaminate.drop_contaminated(odd, twice)
    assert kept.columns == odd.columns and {(r.doc_id, r.keep) for r in kept.collect()} == {(1, "x")}


def test_toxicity_of_wholly_toxic_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    bad = ["zorkan", "zorkel", "zorkix"]
    data = [(i, " ".join(r.choice(bad) if i % 4 == 0 and r.random() < 0.1 else r.choice(words) for _ in range(80)), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    toxic = ["zorkan", "zorkel zorkix", "zorkan " * 40, " ".join(bad * 20), f"{words[0]} zorkan zorkel"]
    clean = ["", words[0], f"{words[1]} {words[2]}", " ".join(words)]
    odd = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    got = [x.predicted for x in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert got == [1] * len(toxic) + [0] * len(clean)
    assert [x.doc_id for x in toxicity.drop_toxic(odd, model).orderBy("doc_id").collect()] == list(range(len(toxic), len(toxic + clean)))


def test_bpe(docs, none, rows):
    ranks = bpe.parse_ranks(bpe.read_ranks(PATH))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    odd = ["".join(r.choice("ab \n\té日🙂'sldre01\x1c\x85.,!") for _ in range(40)) for _ in range(300)] + [" " * 500, "<|endoftext|>"]
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.StreamDecoder(ranks)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN, 1e-5, 4)  # tables that are full all the time
    for t in odd:
        assert small.encode(t) == encoder.encode(t) and len(small.pieces) <= small.half
        ids = np.frombuffer(encoder.encode(t), "<u4")
        assert ids.tolist() == reference.encode_ordinary(t)
        assert b"".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) == t.encode()
        decoder.close()
    with pytest.raises(ValueError):
        decoder.feed([ranks[b"\xff"]])
    clash = docs.withColumn("token_ids", F.lit("x"))
    assert {r.doc_id: r.token_ids for r in bpe.encode_table(clash, PATH, public_tokenizers.PATTERN).collect() if r.doc_id == 9004} == {9004: reference.encode_ordinary("one")}
    got = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    ids = lambda t: reference.encode_ordinary(t or "")
    want = sorted((str(i), len(ids(t)), hashlib.sha256(np.array(ids(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_decode(none, PATH, public_tokenizers.PATTERN).count() == 0


def owners(parts, reference, rule):
    """By definition, token by token: how many tokens each part of a text gets, and how many lie in more than one."""
    text = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    of = lambda byte: int(np.searchsorted(ends, byte, "right"))
    out, crossing, at = [0] * len(parts), 0, 0
    for i in reference.encode_ordinary(text.decode()):
        n = len(reference.decode_single_token_bytes(i))
        held = [of(x) for x in range(at, at + n)]
        crossing += len(set(held)) > 1
        out[{"start": held[0], "end": held[-1], "most": max(sorted(set(held)), key=lambda x: (held.count(x), -x))}[rule]] += 1
        at += n
    return out, crossing


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_token_counts(spark, docs, none, rows, rule):
    ranks = bpe.parse_ranks(bpe.read_ranks(PATH))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts.token_counts(docs, PATH, public_tokenizers.PATTERN, rule=rule).collect()
    split = lambda t: [x.encode() for x in re.findall(r"[^\n]*\n|[^\n]+", t or "")]
    want = sorted((str(i), *owners(split(t), reference, rule)) for i, t in rows)
    assert sorted((str(r.doc_id), r.section_tokens, r.n_crossing) for r in got) == want
    assert all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in got)
    assert token_counts.token_counts(none, PATH, public_tokenizers.PATTERN).count() == 0
    fields = spark.createDataFrame([(1, "a title", None, "body of\nthe text"), (2, "", "", ""), (3, "é" * 9, "  x", "")], "doc_id long, text string, sizes string, body string")
    got = token_counts.token_counts(fields, PATH, public_tokenizers.PATTERN, rule=rule, fields=["text", "sizes", "body"], separator=" | ").orderBy("doc_id").collect()
    for r, own in zip(got, fields.orderBy("doc_id").collect(), strict=True):
        parts = [((own[k] or "") + (" | " if k < 3 else "")).encode() for k in (1, 2, 3)]
        assert (r.section_tokens, r.n_crossing) == owners(parts, reference, rule) and r.n_sections == 3


def test_urls(spark):
    data = ["http://A.Example.com/en/7?x", "http://x.com/en/1", "http://evilcom/en/1", "http://a.net/xxx/p", "http://a.net/xxxl", "http://a.net/bets/loan/poker", "http://a.net/bets/bets/bets", "no url", None, "", "https://u.org/es/", "x://h?://y",
            "http://free-win.net/cheap", "http://free.net/WIN", "http://é.net/ads/casino", "http://a.net/" + "y" * 50_000 + "/hentai"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(data)] + [(0, data[0], "x", 1), (None, data[3], "x", 1)], "page_id long, url string, hits string, host long")
    rows = url_filter.judge_urls(df).collect()
    assert len(rows) == len(data) + 2 and {r.verdict for r in rows if r.page_id is None} == {"block"} and len({tuple(r) for r in rows if r.page_id == 0}) == 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert [got[i][3] for i in range(2, 10)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[7][:3] == got[8][:3] == ("", "", None) and got[10][2] == "org/es/" and got[11][:2] == ("h", "")
    assert [got[i][3] for i in range(12, 16)] == ["block", "allow", "block", "block"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    r = random.Random(3)
    terms = {"ab": 1, "abc": 2, "b-c": 9, "ca": 1, "c": 1}
    for _ in range(300):
        u = "".join(r.choice("abcABC-/") for _ in range(r.randint(0, 30)))
        found = {t: len(re.findall(f"(?=(?<![a-z0-9]){re.escape(t)}(?![a-z0-9]))", u.lower())) for t in terms}
        soft = {t for t, n in found.items() if n and terms[t] < 9}
        assert url_filter.Vocabulary(terms).count(u) == (found["b-c"], len(soft), sum(terms[t] for t in soft))


def test_warc(spark, monkeypatch):
    data = [(1, "http://b.org/x", "same"), (2, "http://a.org/y", "same"), (3, None, None), (4, "no", ""), (None, "http://c.org", "é\r\n\r\n"), (5, "http://b.org/x", "other"), (6, "http://b.org/ü b\r\nX-Evil: 1", "z" * 3_000_000)]
    data += [(7, "http://b.org/x", "copy"), (7, "http://b.org/x", "copy"), (8, "http://b.org/x", "copy"), (None, None, None)]
    data += [(100 + i, f"http://h{i % 7}.org/{i % 11}", f"page {i % 13}") for i in range(120)]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in data], "page_id long, url string, html string, payload string, key long").repartition(3)
    for name, value in (("LINES", 4), ("SHARD_LINES", 30), ("READ_BYTES", 500), ("ARCHIVE_BYTES", 40), ("KEPT_BLOCKS", 2), ("LOOKUPS", 5)):
        monkeypatch.setattr(warc, name, value)
    folder = scratch(spark, "w")
    rows = warc.archive_pages(spark, df, folder).collect()
    best: dict = {}
    for i, _, h in data:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = []
    for i, _, h in data:
        first = best.get(h or "")
        again = first is not None and first != i
        want.append((str(i), len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if again else "response", first if again else None))
    assert sorted((str(r.page_id), *r[1:]) for r in rows) == sorted(want)
    shards = warc.shards_of(spark.read.parquet(folder + "/shards"))
    captures, archives = warc.Captures(shards, warc.qualified(spark, folder)), warc.Reader(warc.qualified(spark, folder))
    assert len(shards) > 1
    for u in {u for _, u, _ in data} - {None}:
        assert sorted(h["X-Page-ID"] for h, _ in warc.lookup(u, captures, archives)) == sorted("null" if i is None else str(i) for i, v, _ in data if v == u)
    assert warc.lookup("http://nowhere.org/", captures, archives) == []
    headers = [h for u in {u for _, u, _ in data} - {None} for h, _ in warc.lookup(u, captures, archives)]
    assert len({h["WARC-Record-ID"] for h in headers}) == len(headers) and not any("X-Evil" in h for h in headers)
    assert "http://b.org/%C3%BC%20b%0D%0AX-Evil:%201" in {h["WARC-Target-URI"] for h in headers} and all(h["WARC-Target-URI"].isascii() for h in headers)
    assert warc.archive_pages(spark, df.limit(0), scratch(spark, "w")).count() == 0


def components(rows, size, threshold):
    """By definition: shingle sets of the rows with ids, and the smallest id that links reach."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        if i is not None:
            sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sets, {i: find(i) for i in sets}


def test_near(docs, none, rows, monkeypatch):
    sets, root = components(rows, 3, 85)
    want = {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}
    for large, centres in ((near_dedup.LARGE, near_dedup.CENTRES), (2, 1)):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        monkeypatch.setattr(near_dedup, "CENTRES", centres)
        got = near_dedup.near_groups(docs).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] and len(got) == len(rows)
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_near_in_crowded_buckets(spark, monkeypatch):
    """Texts of one crowd that change step by step: buckets that hold several components, blocks of a few members."""
    r = random.Random(9)
    w = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(70):
        rows.append((i, " ".join(w)))
        for _ in range(r.choice((1, 1, 4, 9))):
            w[r.randrange(60)] = f"w{r.randrange(10**6)}"
    for name, value in (("ROWS", 2), ("LARGE", 3), ("CENTRES", 2), ("BLOCK", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    _, root = components(rows, 3, 85)
    for kind in ("int", "smallint", "decimal(12,0)"):
        assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), rows=2).collect()} == root


def without_repeats(rows):
    """By definition: (words, words removed, digest of the rest) of each distinct row, in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0])):
        w = WORD.findall(t or "")
        off = [False] * len(w)
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            if x in seen:
                off[j : j + 20] = [True] * 20
            seen.add(x)
        kept = [a for a, o in zip(w, off, strict=True) if not o]
        out[i] = len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


@pytest.mark.parametrize("hits,shard,run,block,piece", [(40, 400_000, 64, 1 << 18, 1 << 19), (2, 400_000, 64, 1 << 18, 1 << 19), (10**6, 60, 7, 1 << 18, 300), (3, 100, 5, 40, 200)])
def test_substrings(docs, none, rows, monkeypatch, hits, shard, run, block, piece):
    """As it is; with common anchors; with overfull shards; with short runs, blocks and pieces."""
    for name, value in (("HITS", hits), ("SHARD_WORDS", shard), ("RUN", run), ("BLOCK", block)):
        monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(words, "PIECE", piece)
    got = substring_dedup.remove_repeats(docs, with_text=True).collect()
    want = without_repeats(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *x) for i, x in want.items()}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_texts_that_repeat_themselves(spark):
    """Words in circles: equal windows of one text, within one segment and across segments; and the documents of a real table."""
    r = random.Random(12)
    rows = []
    for i in range(160):
        circle = [f"w{r.randrange(10**6)}" for _ in range(r.randint(1, 24))]
        rows.append((i, " ".join([*(f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 9))), *(circle * 40)[: r.randint(20, 120)], *(f"y{r.randrange(10**6)}" for _ in range(r.randint(0, 9)))])))
    rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(docs).collect()}
    assert got == without_repeats(rows)


def test_one_passage_in_many_contexts(spark, monkeypatch):
    """A passage that all texts share between words of their own: its anchors have as many entries as there are texts."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(45)]
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(own(r.randint(0, 30)) + passage + own(r.randint(0, 30)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hits, shard in ((40, 400_000), (10**6, 400_000), (10**6, 500)):
        monkeypatch.setattr(substring_dedup, "HITS", hits)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
        assert got == without_repeats(rows)


def test_segments_cover_all_windows_alike(monkeypatch):
    """Whatever the sizes of pieces, blocks and runs: each window lies in one segment, and equal windows have equal anchors."""
    r = random.Random(7)
    own = ["", " ", "a " * 300, "é" * 50, *(" ".join(r.choice("abcdefgh") * r.randint(1, 20) for _ in range(r.randint(0, 90))) for _ in range(40))]
    keys, seen = words.new_keys(substring_dedup.Cutter.n_keys()), set()
    for piece, block, run in ((1 << 19, 1 << 18, 64), (100, 1 << 18, 64), (1 << 19, 30, 3), (64, 25, 1)):
        monkeypatch.setattr(words, "PIECE", piece)
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        monkeypatch.setattr(substring_dedup, "RUN", run)
        cutter, of = substring_dedup.Cutter(keys), {}
        for begin, h, first in words.Words(keys)(pa.array(own)):
            assert np.diff(first).tolist() == [len(t.split()) for t in own[begin : begin + len(first) - 1]]
            for cols in cutter(h, first):
                for text, at, n, a, *_ in zip(*(c.tolist() for c in cols), strict=True):
                    assert n <= run and not any((begin + text, at + k) in of for k in range(n))
                    of |= {(begin + text, at + k): a for k in range(n)}
        assert set(of) == {(i, j) for i, t in enumerate(own) for j in range(len(t.split()) - 19)}
        by_window: dict = {}
        for (i, j), a in of.items():
            assert by_window.setdefault(tuple(own[i].split()[j : j + 20]), a) == a
        seen.add(tuple(sorted(of.items())))
    assert len(seen) == 1


def test_index_finds_intervals():
    """Matching against all windows of random segments over few words."""
    r = np.random.default_rng(1)
    for _ in range(60):
        window = int(r.integers(2, 6))
        parts = [r.integers(0, r.integers(1, 4), r.integers(window, 15)).astype(np.uint64) for _ in range(r.integers(1, 12))]
        seen, want = set(), set()
        for i, x in enumerate(parts):
            for j in range(len(x) - window + 1):
                want |= {(i, j)} if tuple(x[j : j + window]) in seen else set()
                seen.add(tuple(x[j : j + window]))
        found = substring_dedup.repeats(np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])), window)
        assert {(int(i), int(j + k)) for i, j, n in zip(*found, strict=True) for k in range(n)} == want


def test_decontaminate(spark, none):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [(i, " ".join(r.choice(base) for _ in range(r.randint(15, 50)))) for i in range(60)] + [(90, None), (91, ""), (92, items_ := "ab cd")]
    data = []
    for i in range(200):
        t = [r.choice(base) for _ in range(r.randint(0, 300))]
        if i % 3 == 0:
            at = r.randint(0, len(t))
            t[at:at] = r.choice(items[:60])[1].upper().split()
        data.append((i, " ".join(t)))
    data += [(900, None), (901, ""), (902, "x " + items_)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in data:
        w = decontaminate.words_of((t or "").lower())
        for k, x in items:
            if x and min(decontaminate.overlaps(decontaminate.words_of(x.lower()), decontaminate.shingles(w), w)) >= 0.8:
                want.add((i, k))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want and len(want) > 60
    assert decontaminate.drop_contaminated(df, bench).count() == len(data) - len({i for i, _ in want})
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0


def test_pipeline(spark):
    """Each stage on its own input against brute force; the last counts the tokens of what is left."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: rows[r.doc_id] for r in scores.collect() if r.score < toxicity.THRESHOLD}
    assert set(rows) == {r.doc_id for r in kept.collect()}
    best: dict = {}
    for i, t in rows.items():
        best[low(t)] = max(i, best.get(low(t), i))
    rows = {i: rows[i] for i in best.values()}
    kept = stages["exact_dedup"](spark, kept, sf)
    assert set(rows) == {r.doc_id for r in kept.collect()}
    _, root = components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    kept = stages["near_dedup"](spark, kept, sf)
    assert set(rows) == {r.doc_id for r in kept.collect()}
    items = [decontaminate.words_of(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def holds(t):
        w = decontaminate.words_of((t or "").lower())
        return any(min(decontaminate.overlaps(x, decontaminate.shingles(w), w)) >= 0.8 for x in items)

    rows = {i: t for i, t in rows.items() if not holds(t)}
    kept = stages["decontamination"](spark, kept, sf)
    assert set(rows) == {r.doc_id for r in kept.collect()} and kept.columns == docs.columns
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(PATH)), special_tokens={})
    assert {i: r.n_tokens for i, r in out.items()} == {i: len(reference.encode_ordinary(t or "")) for i, t in rows.items()}


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names, and an empty table."""
    sf = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "a text of its own with some words in it", None, None, None), (5001, None, "en", "s", None), (5002, "", "en", "s", 0), (5003, "word " * 40_000, "en", "s", 200_000), (5004, "tie of two", "en", "s", 1), (5005, "TIE of two", "en", "s", 1), (5004, "tie of two", "en", "s", 1)]
    docs = spark.createDataFrame(odd, own.schema).withColumns({"keep": F.lit("x"), "id": F.lit(1), "rid": F.lit(2), "row": F.lit(3), "norm": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        want = [i for i, *_ in odd] if name in ("toxicity", "decontamination") else [5001, 5003, 5005, None] if name == "exact_dedup" else [5001, 5002, 5003, 5004, 5004, None]
        if name == "exact_dedup":  # a null text is an empty one
            want[0] = 5002
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.fit(own, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            want = [r.doc_id for r in scores if r.score < toxicity.THRESHOLD]
            assert len(scores) == len(odd)
        assert ids == sorted(want, key=str), name
    assert corpus_pipeline.tokenize(spark, docs, sf).count() == len(odd) and corpus_pipeline.tokenize(spark, docs.limit(0), sf).count() == 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    """Each table empty, and all of them: no documents give no rows, no labels and no benchmark items drop nothing."""
    sf = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    few = tables["documents"].limit(20)
    for n, empty in enumerate((("documents",), ("labels", "benchmark"), tuple(tables))):
        for t, df in tables.items():
            (df.limit(0) if t in empty else few if t == "documents" else df).write.parquet(f"{tmp_path}/{n}/{t}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{n}")
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert got.count() == 0 if "documents" in empty else 0 < got.count() <= 20
