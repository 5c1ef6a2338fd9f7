"""Token counts by section or field: whole texts are encoded once, and token spans are joined to the spans of sections or fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe import MAX_TEXTS, text_key, vocabulary, worker_encoder
from attestor.llm.common import small_batches, text_or_empty, trim

#: To which section a token over a boundary counts: that of its first or last byte, or the one with most of its bytes (the first of equals).
START, END, MOST = "start", "end", "most"


def section_starts(text: str, separator: str = "\n") -> np.ndarray:
    """Byte offsets at which sections begin: the start and what follows each separator, which belongs to the section that it ends."""
    mark, data = re.escape(separator.encode()), text.encode()
    found = [m.end() for m in re.finditer(mark, data)]
    return np.array([0] + [x for x in found if x < len(data)], np.int64) if data else np.zeros(0, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens lie in more than one. Both sides are sorted, so the join is a merge."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    owner = last if rule == END else first
    crossing = np.flatnonzero(first != last)
    if rule == MOST and len(crossing):
        owner = owner.copy()
        bounds = np.append(sections, np.iinfo(np.int64).max)
        for i in crossing:
            inside = range(first[i], last[i] + 1)
            owner[i] = max(inside, key=lambda s: (min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]), -s))
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = START, fields: list[str] | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, n_sections, n_crossing, section_tokens (array<bigint>, sums to n_tokens).

    A section ends with its separator. With fields, these columns are encoded as one text, joined by separators, and each is
    a section, an empty one too; a null field is an empty one. Without, a null text is an empty one: no tokens and no
    sections. Very long texts are encoded whole. Ids may repeat or be null, repeated rows are counted by themselves; other
    columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    if rule not in (START, END, MOST):
        raise ValueError(f"unknown rule {rule!r}")
    small_batches(docs.sparkSession)
    shared = vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "n_sections", "n_crossing", "section_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        ranks = encoder.transducer.ranks
        known: dict[bytes, tuple[np.ndarray, int]] = {}
        gap = len(separator.encode())
        length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for t, i in ranks.items():
            length[i] = len(t)
        for batch in batches:
            n_tokens, n_sections, n_crossing, counts, offsets = [], [], [], [], [0]
            for text, sizes in zip(batch.column(1), batch.column(2), strict=True):
                text, sizes = text.as_py(), sizes.as_py()
                key = text_key(text) + repr(sizes).encode()
                if key in known:  # a copy of a text that this worker has had
                    own, crossing = known[key]
                    n_tokens.append(int(own.sum()))
                    n_sections.append(len(own))
                    n_crossing.append(crossing)
                    counts.append(own)
                    offsets.append(offsets[-1] + len(own))
                    continue
                ends = np.cumsum(length[np.frombuffer(encoder.encode(text), "<u4")])
                sections = section_starts(text, separator) if sizes is None else np.append(0, np.cumsum(np.array(sizes) + gap))[:-1]
                own, crossing = attribute(np.append(0, ends[:-1])[: len(ends)], ends, sections, rule)
                if len(known) >= MAX_TEXTS:
                    known.clear()
                known[key] = (own, crossing)
                n_tokens.append(len(ends))
                n_sections.append(len(sections))
                n_crossing.append(crossing)
                counts.append(own)
                offsets.append(offsets[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_sections, pa.int64()), pa.array(n_crossing, pa.int64()), lists], names)
            batch = text = ends = None
            trim()

    text, sizes = text_or_empty(text_col), F.lit(None).cast("array<int>")
    if fields:
        text, sizes = F.concat_ws(separator, *(text_or_empty(f) for f in fields)), F.array(*(F.octet_length(text_or_empty(f)) for f in fields))
    return docs.select(id_col, text.alias("text"), sizes.alias("sizes")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>")
