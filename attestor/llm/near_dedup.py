"""Near-duplicates by MinHash bands, sequential Bayesian verification of signatures, and exact comparison of what is left.

Texts with the same set of shingles form one class, of which the smallest id stands for all. Bands of the classes'
signatures give buckets. A bucket isn't expanded into pairs: first all its members are compared with its smallest one,
in large buckets with a few more, and the components that this gives are set apart. What may still be linked then are
members of one bucket in different components. They are compared block against block, those outside a bucket's largest
component with all others. So each pair of a bucket is either compared or already linked by a chain.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestor.llm.common import give_back, release, small_batches, stored, text_or_empty
from attestor.llm.graph import components, contracted

#: Rows of a band; the chance that a pair at the threshold shares no band, and that a batch's posterior drops one.
ROWS, MISS, PRUNE = 6, 1e-6, 1e-6
#: Values of a signature that are compared, and those between two looks at the posterior.
COMPARED, BATCH = 96, 32
#: Buckets of more members get so many further centres if one star leaves them in several components.
LARGE, CENTRES = 16, 8
#: Members of a block, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Bits of the map of wanted ids by which texts are passed over before they are shuffled; its size never changes.
MAP_BITS = 1 << 20
MAX_WORDS = 150_000


def bands_for(threshold: tuple[int, int], rows: int = ROWS, miss: float = MISS) -> int:
    """The least number of bands that keeps the chance of a miss at the threshold."""
    t = threshold[0] / threshold[1]
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(t**rows, 1 - 1e-12))))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Shingler:
    """The distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size, self.words = size, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: lower() turns A-Z only, split() parts at \x20 and \x09-\x0D
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


class Signer:
    def __init__(self, values: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.xor = r.integers(0, 2**64, values, np.uint64)
        self.odd = r.integers(0, 2**63, values, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.xor), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 512):
            out = np.minimum(out, ((hashes[at : at + 512, None] ^ self.xor) * self.odd).min(0))
        return (out >> np.uint64(32)).astype("<u4")


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = (out ^ parts[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def least_matches(values: int, threshold: float, prune: float = PRUNE, batch: int = BATCH) -> list[tuple[int, int]]:
    """(compared, matches below which the posterior of similarity >= threshold is under prune), for a uniform prior.

    After m matches of n the posterior is Beta(m + 1, n - m + 1); its tail is a sum of binomial terms.
    """
    out = []
    for n in [*range(batch, values, batch), values]:
        tail, least = 0.0, 0
        for k in range(n + 1):
            tail += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if tail >= prune:
                least = k
                break
        out.append((n, least))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n, fp (of the set), sig, keys; the last three are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingles, sign = Shingler(shingle), Signer(bands * rows)
        for batch in batches:
            n, fp, sig, keys = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                n.append(len(own))
                s = sign(own) if len(own) else None
                fp.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig.append(None if s is None else s[:COMPARED].tobytes())
                keys.append(None if s is None else band_keys(s, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "fp", "sig", "keys"])
        shingles = sign = batch = own = None
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, fp binary, sig binary, keys array<bigint>")


def _likely(pairs: DataFrame, signed: DataFrame, threshold: tuple[int, int], values: int) -> DataFrame:
    """The pairs (a, b) that no look at their signatures drops."""
    looks = least_matches(min(values, COMPARED), threshold[0] / threshold[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.stack([np.frombuffer(x.as_py(), "<u4") for x in batch.column(k)]) for k in (2, 3))
            live, found, seen = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in looks:
                found[live] += (left[live, seen:n] == right[live, seen:n]).sum(1)
                live, seen = live[found[live] >= least], n
                if not len(live):
                    break
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(live)) for k in (0, 1)], ["a", "b"])

    sig = signed.select("rid", "sig")
    both = pairs.join(sig.select(F.col("rid").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rid").alias("b"), F.col("sig").alias("sb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _noted(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows whose value is among ids, and a few others: those whose hash has a bit that an id has set too."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)).cast("int")
    bits = ids.select(bit(ids.columns[0]).alias("set")).distinct()  # MAP_BITS small rows at most
    return rows.withColumn("bit", bit(col)).join(F.broadcast(bits), F.col("bit") == F.col("set"), "left_semi").drop("bit")


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rid and the sorted shingles of its text as bytes, for the ids wanted (one column, distinct)."""
    kind = ids.schema["rid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingles = Shingler(shingle)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["rid", "own"])
        shingles = batch = None
        give_back()

    texts = _noted(docs.select(F.col(id_col).alias("rid"), text_or_empty(text_col).alias("text")), "rid", ids).join(ids, "rid", "left_semi")
    return texts.mapInArrow(run, f"rid {kind}, own binary")


def _similar(x: bytes, y: bytes, threshold: tuple[int, int]) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    same = len(np.intersect1d(x, y, assume_unique=True))
    return threshold[1] * same >= threshold[0] * (len(x) + len(y) - same)


def _across(members: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: tuple[int, int], values: int) -> DataFrame:
    """Links between different roots among members (g, rid, n, root): of each g those with another root than g meet all
    others. Blocks are made by hashes and bounded, and each pair of blocks is a row of its own."""
    minor = F.col("root") != F.col("g")
    sized = members.groupBy("g", minor.alias("minor")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sized = stored(sized, "blocks")
    ids = stored(members.select("rid").distinct(), "wanted")
    full = members.join(reps.select("rid", "sig", "keys"), "rid").join(_sets(ids, docs, id_col, text_col, shingle), "rid")
    placed = full.withColumn("minor", minor).join(sized, ["g", "minor"]).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(9)), "blocks").cast("int"))
    packed = stored(placed.groupBy("g", "minor", "block").agg(F.collect_list(F.struct("rid", "root", "n", "keys", "sig", "own")).alias("all")), "packed")
    own = sized.filter("minor").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    other = sized.select("g", F.col("minor").alias("m"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    meets = own.join(other, "g").filter("not m or x <= y")
    left = packed.filter("minor").select("g", F.col("block").alias("x"), F.col("all").alias("one"))
    right = packed.select("g", F.col("minor").alias("m"), F.col("block").alias("y"), F.col("all").alias("two"))
    looks = least_matches(min(values, COMPARED), threshold[0] / threshold[1])
    kind = members.schema["rid"].dataType.simpleString()
    arrow = to_arrow_type(members.schema["rid"].dataType)

    def load(rows: list[dict]) -> tuple:
        return np.array([r["root"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["keys"] for r in rows], np.int64), np.stack([np.frombuffer(r["sig"], "<u4") for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                one, two = one.as_py(), two.as_py()
                (ra, na, ka, sa), (rb, nb, kb, sb) = load(one), load(two)
                shared = np.zeros((len(one), len(two)), bool)
                for k in range(ka.shape[1]):
                    shared |= ka[:, None, k] == kb[None, :, k]
                shared &= (ra[:, None] != rb[None, :]) & (np.minimum(na[:, None], nb) * threshold[1] >= np.maximum(na[:, None], nb) * threshold[0])
                i, j = np.nonzero(shared)
                found, seen = np.zeros(len(i), np.int64), 0
                for n, least in looks:
                    found += (sa[i, seen:n] == sb[j, seen:n]).sum(1)
                    good, seen = found >= least, n
                    i, j, found = i[good], j[good], found[good]
                done: set = set()  # roots that a link of this pair of blocks has joined already
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if (ra[x], rb[y]) not in done and _similar(one[x]["own"], two[y]["own"], threshold):
                        done |= {(ra[x], rb[y]), (rb[y], ra[x])}
                        a.append(one[x]["rid"])
                        b.append(two[y]["rid"])
            yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], ["a", "b"])

    met = meets.join(left, ["g", "x"]).join(right, ["g", "m", "y"])
    return met.select("one", "two").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are as similar as the threshold asks, by integers."""
    kind = pairs.schema["a"].dataType.simpleString()
    wanted = stored(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            take = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if _similar(x.as_py(), y.as_py(), threshold):
                    take.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(take, pa.int64())) for k in (0, 1)], ["a", "b"])

    own = stored(_sets(wanted, docs, id_col, text_col, shingle), "sets")
    both = pairs.join(own.select(F.col("rid").alias("a"), F.col("own").alias("oa")), "a").join(own.select(F.col("rid").alias("b"), F.col("own").alias("ob")), "b")
    return both.select("a", "b", "oa", "ob").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: tuple[int, int] = (85, 100), rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach), kept (id = component_id).

    Words part at \\x20 and \\x09-\\x0D, with A-Z lower-cased; a text of fewer than shingle words is one shingle. Texts
    without words (or null) link with nothing. Linked are texts whose sets have intersection / union >= threshold, a
    fraction; a link is found unless chance hides it, with MISS for the bands and PRUNE for each look. Rows with a null
    id stand alone, have a null component and are kept. Rows that repeat an id count as one text, linked through any of
    them. Very long texts have all their
    shingles compared. An empty table gives an empty result; other columns are ignored. Sets are those of 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    bands = bands_for(threshold, rows)
    signed = stored(_signed(docs, id_col, text_col, shingle, bands, rows), "signed")
    members = signed.select("id", "n", "fp")
    reps = stored(
        signed.filter("fp is not null and id is not null").groupBy("fp").agg(F.min(F.struct("id", "n", "sig", "keys")).alias("r")).select("fp", F.col("r.id").alias("rid"), "r.n", "r.sig", "r.keys"),
        "classes",
    )
    banded = reps.select("rid", "n", F.explode("keys").alias("key"))
    close = lambda x, y: (F.least(x, y) * threshold[1] >= F.greatest(x, y) * threshold[0])  # noqa: E731  sizes alone can rule a pair out
    # What is known of buckets is stored before members are joined to it, so that Spark can split a bucket with many members.
    first = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rid", "n")).alias("c")).filter("size > 1"), "buckets")
    stars = banded.join(first, "key").filter((F.col("rid") != F.col("c.rid")) & close(F.col("n"), F.col("c.n"))).select(F.col("c.rid").alias("a"), F.col("rid").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        likely = stored(_likely(pairs, reps, threshold, bands * rows), "likely")
        return stored(_linked(likely, docs, id_col, text_col, shingle, threshold), "links")

    comp = components(verified(stars))

    def mixed(comp: DataFrame, of: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with these."""
        known = of.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n", "key", F.coalesce("root", "rid").alias("root"))
        several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high").select("key", "size")
        several = stored(several, "buckets")
        return stored(known.join(several, "key"), "mixed")

    # Large buckets: more centres, taken by hashes, so that what is linked by chains need not be compared in pairs.
    known = mixed(comp, banded)
    large = known.filter(F.col("size") > LARGE)
    centres = large.groupBy("key").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("rid", F.lit(i)).alias("h"), "rid", "n", "root"))["rid"] for i in range(CENTRES)))).alias("c"))
    centres = centres.select("key", F.explode("c").alias("x")).join(large.select("key", F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx")), ["key", "x"])
    centres = stored(centres, "centres")
    spokes = large.join(centres, "key").filter((F.col("root") != F.col("rx")) & close(F.col("n"), F.col("nx"))).select(F.least("rid", "x").alias("a"), F.greatest("rid", "x").alias("b")).distinct()
    more = verified(spokes)
    if not more.isEmpty():
        comp = components(contracted(comp).union(more))
        known = mixed(comp, known.select("rid", "n", "key"))

    # What is left: members of one bucket in different components.
    largest = known.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    around = stored(known.join(largest, "key").select(F.col("most").alias("g"), "rid", "n", "root").distinct(), "members")
    more = stored(_across(around, reps, docs, id_col, text_col, shingle, threshold, bands * rows), "links")
    if not more.isEmpty():
        comp = components(contracted(comp).union(more))

    of_class = reps.select("fp", "rid").join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("fp", F.coalesce("root", "rid").alias("root"))
    found = members.join(of_class, "fp", "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that near_groups keeps, with all their columns; rows with a null id stay."""
    gone = near_groups(docs, id_col, text_col, shingle, threshold).filter("not kept").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
