"""Words of many texts at once, as keyed 64-bit hashes.

Words part at \\x20 and \\x09-\\x0D. A batch's texts lie in one buffer, so a piece of it is cut and hashed by whole-array
steps. Keys are drawn for each run, so no text can be made to collide with another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are cut at once; a longer text is cut in pieces of about this size.
PIECE = 1 << 19

_next_space = re.compile(rb"[\x20\x09-\x0D]").search
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def new_keys(n: int) -> tuple[int, ...]:
    """Odd 64-bit numbers."""
    return tuple(int(x) | 1 for x in np.random.default_rng().integers(0, 2**64, n, np.uint64))


def mixed(x: np.ndarray, key: int, shift: int = 32) -> np.ndarray:
    out = x * np.uint64(key)
    out ^= out >> np.uint64(shift)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each begins, with one more for the end."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(ends, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8), bounds


class Words:
    def __init__(self, keys: tuple[int, ...]):
        self.keys = keys[:4]

    def _piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(data)
        padded = np.zeros(size + 8, np.uint8)
        padded[:size] = data
        word = ~SPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < size)]
        opens[inner], closes[inner - 1] = word[inner], word[inner - 1]
        starts = np.flatnonzero(opens)
        left = np.flatnonzero(closes) + 1 - starts
        eight = np.ndarray(size + 1, "<u8", padded, strides=(1,))
        a, b, c, d = self.keys
        h = eight[starts] & _MASK[np.minimum(left, 8)]
        h ^= left.astype(np.uint64) * np.uint64(a)
        h = mixed(mixed(h, b), c, 29)
        more = np.flatnonzero(left > 8)
        at = 8
        while len(more):
            rest = left[more] - at
            h[more] = mixed(h[more] ^ mixed(eight[starts[more] + at] & _MASK[np.minimum(rest, 8)], d), b, 29)
            more, at = more[rest > 8], at + 8
        return h, np.searchsorted(starts, bounds)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's number, the hashes of all their words, and where each text's words begin, with one more for the end."""
        data, bounds = buffers(column)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1)
            part = data[bounds[i] : bounds[j]]
            if len(part) <= PIECE:
                yield i, *self._piece(part, bounds[i : j + 1] - bounds[i])
            else:  # one long text
                pieces, at = [], 0
                while at < len(part):
                    found = _next_space(part, min(at + PIECE, len(part)))
                    end = found.start() if found else len(part)
                    pieces.append(self._piece(part[at:end], np.array([0, end - at]))[0])
                    at = end
                h = np.concatenate(pieces)
                yield i, h, np.array([0, len(h)])
            i = j
