"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole. A token's span of bytes follows from the bytes that its id stands for, and
its span of characters from the bytes that begin a character; a token that holds part of a character spans all of it.
Spans and sections are both in order of position, so each interval join is a binary search within the document. A token
that touches several sections goes by an explicit rule: "majority" to the one with the most of its characters, the
earlier on a tie; "start" to the one of its first character; "end" to that of its last; "share" to each in proportion.

Defined results: a null text is empty. A section without tokens counts 0. Tokens outside all sections are returned
under section -1. Sections may be in any order but must not overlap; empty ones are allowed. Rows whose sections are null
or empty have all their tokens under -1. Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_chunks

RULES = ("majority", "start", "end", "share")


def spans(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, for each token."""
    ids = np.frombuffer(bpe_chunks.encode(path, text), "<u4").astype(np.int64)
    raw = text.encode()
    ends = np.cumsum(bpe_chunks.token_bytes(path)[ids])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
    if len(raw) == len(text):
        return starts, ends
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attribute(first: np.ndarray, last: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, how many of them touch another section too, and the tokens outside all sections."""
    k = len(sections)
    counts, crossing = np.zeros(k), np.zeros(k, np.int64)
    order = np.lexsort((sections[:, 1], sections[:, 0])) if k else np.zeros(0, np.int64)
    order = order[sections[order, 1] > sections[order, 0]] if k else order
    if not len(order):
        return counts, crossing, float(len(first))
    begin, end = sections[order, 0], sections[order, 1]
    low = np.searchsorted(end, first, "right")  # the first section that ends after the token's start
    high = np.searchsorted(begin, last, "left") - 1  # the last that begins before its end
    inside = low == high
    counts[order] += np.bincount(low[inside], minlength=len(order))
    for t in np.flatnonzero(low < high):
        met = np.arange(low[t], high[t] + 1)
        share = np.minimum(end[met], last[t]) - np.maximum(begin[met], first[t])
        if rule == "share":
            counts[order[met]] += share / share.sum()
            crossing[order[met]] += 1
        else:
            to = order[met[{"majority": int(share.argmax()), "start": 0, "end": -1}[rule]]]
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing, float((low > high).sum())


SCHEMA = "doc_id long, section int, first long, last long, n_tokens double, n_crossing long"


def line_bounds(text: str) -> np.ndarray:
    """Sections of a text, one per line: the line with its line feed."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], 1)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sections_col: str | None = None, rule: str = "majority", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, section, first, last, n_tokens, n_crossing for each section of each row.

    sections_col: array<struct<first, last>> of code points, last excluded; without it each line is a section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = tokenizer_path or bpe_chunks.default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                out: list[list] = [[] for _ in schema]
                given = b.column(2).to_pylist() if sections_col else [None] * b.num_rows
                for key, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), given, strict=True):
                    text = text or ""
                    bounds = np.array([(s["first"], s["last"]) for s in own or []], np.int64).reshape(-1, 2) if sections_col else line_bounds(text)
                    counts, crossing, outside = attribute(*spans(path, text), bounds, rule)
                    rows = [range(len(bounds)), bounds[:, 0].tolist(), bounds[:, 1].tolist(), counts.tolist(), crossing.tolist()]
                    if outside:
                        rows = [[*r, x] for r, x in zip(rows, (-1, None, None, outside, 0), strict=True)]
                    out[0] += [key] * len(rows[0])
                    for column, values in zip(out[1:], rows, strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else [])]
    return docs.select(*columns).mapInArrow(run, SCHEMA)
