"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by an incremental UTF-8 state machine.

Encoding. Let last(p) be the last token of the encoding of a prefix p. It is the one token t that ends p and whose
neighbour last(p without t) forms a stable pair with it: merging the bytes of both gives just the two tokens back. So
the encodings of all prefixes form a tree, and a byte adds one node. Of the tree only the part matters that later bytes
can still reach: prefixes behind which a token may have begun. Where all their chains meet in one boundary, the tokens up
to it are emitted. What remains, the bytes since and their last tokens, is the state; the token before the boundary
stays in a register, as a transition asks of it only whether it forms a stable pair with the whole of the bytes. Token
lengths bound the lookahead, so the states are finite; they are made on demand and kept in a bounded table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import give_back, kept, release, small_batches, text_or_empty, trim

#: Entries of the transition table, the pair table and the table of heads; a full table is emptied and filled anew.
MAX_STATES, MAX_PAIRS, MAX_HEADS = 150_000, 200_000, 40_000
#: Entries of the piece cache, some 200 bytes each, and of that of a worker that others will share its memory with. Half of
#: them are new ones; when these are full, they become the old ones, and what was old and hasn't been met since is forgotten.
MAX_PIECES, FEW_PIECES = 600_000, 125_000
#: Bytes of a head: where the first so many bytes of a piece lead is looked up at once.
HEAD = 5
#: Texts whose results a worker remembers, by cryptographic hashes of 128 bits.
MAX_TEXTS = 50_000
#: A vocabulary of more bytes than this isn't broadcast.
MAX_VOCABULARY = 64 << 20


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is; its size is checked as it goes to every worker."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


SINGLE = [bytes((b,)) for b in range(256)]


class State:
    """Bytes pending, the last token of each of their prefixes (-2: none), and the live prefixes: those behind which a
    token may have begun. moves: by byte, the token that asks for the register (or -1) and where "no" and "yes" lead, with the
    tokens emitted on the way; None where nothing has gone yet."""

    __slots__ = ("pending", "lasts", "live", "moves", "end")

    def __init__(self, pending: bytes, lasts: tuple[int, ...], live: tuple[int, ...]):
        self.pending, self.lasts, self.live, self.moves, self.end = pending, lasts, live, {}, None


class Transducer:
    """Encodes byte strings."""

    def __init__(self, ranks: dict[bytes, int], tables: float = 1.0):
        """tables: the share of the tables' entries."""
        self.max_states, self.max_pairs, self.max_heads = (int(n * tables) for n in (MAX_STATES, MAX_PAIRS, MAX_HEADS))
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.heads = {t[:n] for t in ranks for n in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.states: dict[tuple, State] = {}
        self.reset()

    def reset(self) -> None:
        for state in self.states.values():
            state.moves.clear()  # states lead to each other in circles, which only a collection would free
        self.start = State(b"", (), (0,))
        self.states = {(b"", ()): self.start}
        self.firsts: dict[bytes, tuple[State, list[int]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges by definition, the pair of lowest rank first, the leftmost of equals, until at most two parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(((self.ranks[ab], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in self.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; none for a single byte, or a token that merges don't make."""
        if token not in self.halves:
            parts = self.merged(self.token[token])
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _alone(self, token: int) -> bool:
        """Whether merging its bytes gives the token."""
        return self.size[token] == 1 or self._halves(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Left -1 is the start of a piece, where the right token has to stand alone. Else: whether merging the bytes of both gives just the two back. Undoes their merges from the last, always the later
        one first, and asks each time whether the tokens that meet would have merged sooner than what was undone."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self._stable(left, right) if left >= 0 else self._alone(right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        if not (self._alone(left) and self._alone(right)):
            return False
        ranks, token, limit = self.ranks, self.token, len(self.ranks) * 4 + 4
        while True:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and 2 * joined < limit:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = 2 * left, a[1]  # of equal ranks the merge further left comes first
            else:
                limit, right = 2 * right + 1, b[0]

    def _tokens(self, lasts: tuple[int, ...], n: int) -> tuple[int, ...]:
        out = []
        while n > 0:
            out.append(lasts[n - 1])
            n -= self.size[lasts[n - 1]]
        return tuple(reversed(out))

    def _move(self, state: State, byte: int) -> list:
        asked = self.ranks.get(state.pending + SINGLE[byte], -1) if state.live and state.live[0] == 0 else -1
        move = state.moves[byte] = [asked, None, None]
        return move

    def _way(self, state: State, byte: int, last: int) -> tuple[State, tuple[int, ...]]:
        """Where a byte leads. last: the token from the boundary on, where it forms a stable pair with the register; else -2."""
        pending, lasts, heads, ranks, still = state.pending + SINGLE[byte], state.lasts, self.heads, self.ranks, []
        for i in state.live:
            tail = pending[i:]
            if i and last < 0 and (t := ranks.get(tail)) is not None and self.stable(lasts[i - 1], t):
                last = t
            if tail in heads:
                still.append(i)
        return self._next(pending, lasts + (last,), still)

    def _next(self, pending: bytes, lasts: tuple[int, ...], still: list[int]) -> tuple[State, tuple[int, ...]]:
        live, out, size = tuple(still) + (len(pending),) * (lasts[-1] >= 0), (), self.size
        # A boundary behind which no chain of a live prefix passes is dead; one that all of them share is final.
        passed = [0] * (len(pending) + 1)
        for i in live:
            while i > 0:
                passed[i] += 1
                i -= size[lasts[i - 1]]
        cut = next((i for i in range(live[0], 0, -1) if passed[i] == len(live)), 0) if live else 0
        if cut:
            out, pending, live = self._tokens(lasts, cut), pending[cut:], tuple([i - cut for i in live])
        lasts = tuple([t if n else -2 for t, n in zip(lasts[cut:], passed[cut + 1 :])])
        key = (pending, lasts)
        if (target := self.states.get(key)) is None:
            target = self.states[key] = State(pending, lasts, live)
        return target, out

    def _walk(self, state: State, data: bytes, out: list[int]) -> State:
        """Where data leads, after the tokens in out; appends what is emitted on the way."""
        before, pairs = out[-1] if out else -1, self.pairs
        for byte in data:
            move = state.moves.get(byte) or self._move(state, byte)
            asked, way, known = move[0], move[1], False
            if asked >= 0:
                known = pairs.get(before << 32 | asked)
                if known is None:
                    known = self.stable(before, asked)
                if known:
                    way = move[2]
            if way is None:
                way = move[1 + known] = self._way(state, byte, asked if known else -2)
            state, done = way
            if done:
                out += done
                before = done[-1]
        return state

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token itself is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        head = piece[:HEAD]
        if (known := self.firsts.get(head)) is None:
            if len(self.firsts) >= self.max_heads:
                self.firsts.clear()
            out: list[int] = []
            known = self.firsts[head] = (self._walk(self.start, head, out), out)
        out = known[1].copy()
        state = self._walk(known[0], piece[HEAD:], out)
        if state.end is None:
            state.end = self._tokens(state.lasts, len(state.pending))
        out += state.end
        return out


#: The letters of ASCII, and those from the Latin blocks that follow (U+00C0 to U+024F but for two signs).
ASCII_LETTERS, LATIN_LETTERS = "A-Za-z", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Finds what is neither ASCII nor such a letter.
beyond_latin = re.compile("[^\\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search


def spelled_out(pattern: str, letters: str) -> Callable[[str], list[str]]:
    """findall of the pattern for texts of ASCII and the given letters: these and digits spelled out, for the standard library's faster engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two, four = pattern[i : i + 2], pattern[i : i + 5]
        if four in (r"\p{L}", r"\p{N}"):
            own = letters if "L" in four else "0-9"
            out.append(own if inside else f"[{own}]")
            i += 5
            continue
        if two[0] == "\\":
            if two not in (r"\s", r"\S"):
                return regex.compile(pattern).findall  # something else than the classes known here
            out.append(two)
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out.append(two[0])
        i += 1
    return re.compile("".join(out), re.ASCII).findall


class Encoder:
    """Encodes texts as the matches of a pattern, each by itself. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: float = 1.0, pieces: int = MAX_PIECES):
        self.transducer, self.half = Transducer(ranks, tables), max(1, pieces // 2)
        self.find = regex.compile(pattern).findall
        self.find_ascii, self.find_latin = spelled_out(pattern, ASCII_LETTERS), spelled_out(pattern, LATIN_LETTERS)
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece) or self.old.get(piece)
        if got is None:
            ids = self.transducer.encode(piece.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:  # the table stays small in bytes too
            if len(self.pieces) >= self.half:
                self.old, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        known, make = self.pieces.get, self._piece
        find = self.find_ascii if text.isascii() else self.find if beyond_latin(text) else self.find_latin
        return b"".join([known(p) or make(p) for p in find(text)])


#: Next state of the UTF-8 machine for lead bytes, and for each state the bytes that go on and where to. 0: between characters.
_LEADS = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
BAD = -1


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        return next((to for a, b, to in _LEADS if a <= byte <= b), BAD)
    a, b, to = _NEXT[state]
    return to if a <= byte <= b else BAD


class StreamDecoder:
    """Turns ids into UTF-8; feed() gives back whole characters only and holds the bytes of an open one."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def feed(self, ids: Iterable[int] | np.ndarray) -> bytes:
        """Raises on bytes that aren't UTF-8. The machine runs over the last character only; what lies before it begins
        and ends between characters, and is checked as a whole."""
        data = self.held + self._bytes(np.asarray(ids, np.int64))
        cut = len(data)
        while cut and len(data) - cut < 4 and data[cut - 1] >= 0x80:
            cut -= 1
            if data[cut] >= 0xC0:
                break
        state = 0
        for byte in data[cut:]:
            state = utf8_step(state, byte)
            if state == BAD:
                raise ValueError("the ids aren't UTF-8")
        self.state, self.held, whole = (state, data[cut:], data[:cut]) if state else (0, b"", data)
        if not whole.isascii():
            whole.decode()
        return whole

    def close(self) -> None:
        """Raises if a character is left open."""
        if self.state:
            raise ValueError("the ids end within a character")


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(path))


def worker_encoder(data: bytes, pattern: str, keep: bool = True) -> Encoder:
    """The encoder of a Python worker. If it's kept, its states are made once and serve all tasks
    that follow; else its tables are smaller."""
    gc.set_threshold(1_000_000, 50, 50)  # the tables are large and have few cycles
    if not keep:
        release()
        return Encoder(parse_ranks(data), pattern, 0.5, FEW_PIECES)
    return kept(("bpe", hashlib.blake2b(data).digest(), pattern), lambda: Encoder(parse_ranks(data), pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 65_536, keep: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, by the ranks in the file at path.

    keep: workers hold the encoder's tables (about 250 MB when full) for later tasks. Spark deals tasks out over all idle workers, so after
    operators that ran more workers than there are cores, not to keep them takes less memory and more time.

    Ids are decoded chunk by chunk. A null text is an empty one: no tokens, and the hashes of nothing. Ids may repeat
    or be null; other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern, keep)
        decoder = StreamDecoder(encoder.transducer.ranks)
        known: dict[bytes, tuple[int, str, str]] = {}
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1):
                text = text.as_py()
                key = text_key(text)
                if key in known:  # a copy of a text that this worker has had
                    for into, x in zip(rows, known[key], strict=True):
                        into.append(x)
                    continue
                ids = encoder.encode(text)
                decoder.reset()
                said = hashlib.sha256()
                for at in range(0, len(ids), 4 * chunk):
                    said.update(decoder.feed(np.frombuffer(ids[at : at + 4 * chunk], "<u4")))
                decoder.close()
                if len(known) >= MAX_TEXTS:
                    known.clear()
                known[key] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), said.hexdigest())
                for into, x in zip(rows, known[key], strict=True):
                    into.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            batch = text = ids = None
            trim()
        if not keep:
            encoder.transducer.reset()
            encoder = decoder = known = None
            give_back()

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each text as array<int> in out_col, which replaces a column of that name; null texts give empty arrays."""
    small_batches(docs.sparkSession)
    shared = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(shared.value, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(encoder.encode(t), "<u4").astype("int32") for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(out_col, ids(text_or_empty(text_col)))
