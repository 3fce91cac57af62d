"""Packing by vector bins: examples go where the dot product of their demand and the room left is greatest.

A demand has three sides: tokens, segments (always one) and loss-bearing tokens; a sequence has a limit on each. Every
task packs the rows of its own partition in groups of bounded size, so nothing is shuffled or collected. Texts longer
than a sequence are first cut into full ones; the heuristic places the rest; the emptiest sequences are then cut up
to fill the others. What a group leaves unfilled is carried into the next, and at the end of the partition it is cut
into lengths that are powers of two, which need no padding. A group ends at so many pieces or at group_bytes of the ids of
documents that have pieces left, so memory is that and one document.

Defined results: a null text is empty, its ids are the closing id alone. A very long text fills sequences of its own as
it comes. Repeated rows are packed one by one. An empty
table gives no pieces. Columns of the input other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_chunks

CLOSING_ID = b"\0\0\0\0"
#: Sequences that one partition can number.
NUMBERS = 1 << 36


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are positive, and tokens a power of two")


@dataclass(slots=True)
class Piece:
    """Ids start to end of a document; those from loss_from on bear loss."""

    doc: int
    start: int
    end: int
    loss_from: int

    @property
    def size(self) -> int:
        return self.end - self.start

    @property
    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.loss_from))

    def reach(self, tokens: int, loss: int) -> int:
        """The longest cut from the start within both limits."""
        return min(self.size, tokens, max(0, self.loss_from - self.start) + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        at = self.start + n
        return Piece(self.doc, self.start, at, self.loss_from), Piece(self.doc, at, self.end, self.loss_from)


class Sequence:
    def __init__(self, limits: Limits) -> None:
        self.pieces: list[Piece] = []
        self.tokens, self.segments, self.loss = limits.tokens, limits.segments, limits.loss

    def add(self, p: Piece) -> None:
        self.pieces.append(p)
        self.tokens -= p.size
        self.segments -= 1
        self.loss -= p.loss

    @property
    def filled(self) -> int:
        return sum(p.size for p in self.pieces)


def by_dot_product(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """Opens sequences one by one; each takes the fitting piece with the greatest dot product until none fits."""
    tokens = np.array([p.size for p in pieces], np.float64) / limits.tokens
    loss = np.array([p.loss for p in pieces], np.float64) / limits.loss
    one = 1 / limits.segments
    weights = (tokens.mean(), one, loss.mean()) if pieces else (0, 0, 0)
    left, out = len(pieces), []
    while left:
        s = Sequence(limits)
        while left and s.segments:
            room, loss_room = s.tokens / limits.tokens, s.loss / limits.loss
            score = tokens * (room * weights[0]) + loss * (loss_room * weights[2]) + s.segments * one * one * weights[1]
            score[(tokens > room + 1e-9) | (loss > loss_room + 1e-9)] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            s.add(pieces[k])
            tokens[k] = 1e9  # never fits again
            left -= 1
        out.append(s)
    return out


def fill(sequences: list[Sequence], limits: Limits) -> tuple[list[Sequence], list[Piece]]:
    """Cuts the emptiest sequences up into the room of the others: full sequences, and the pieces of those that aren't."""
    order = sorted(sequences, key=lambda s: s.filled)
    done, low, high = [], 0, len(order) - 1
    while low < high:
        target = order[high]
        donor = order[low].pieces
        while target.tokens and target.segments and target.loss and donor:
            p = donor.pop()
            if not (n := p.reach(target.tokens, target.loss)):
                donor.append(p)
                break
            head, tail = p.cut(n)
            target.add(head)
            if tail.size:
                donor.append(tail)
        if donor:
            done.append(target)
            high -= 1
        else:
            low += 1
    rest = [s for s in order[low : high + 1] if s.pieces]
    full = [s for s in [*done, *rest] if s.filled == limits.tokens]
    return full, [p for s in [*done, *rest] if s.filled < limits.tokens for p in s.pieces]


def powers(pieces: list[Piece], limits: Limits) -> list[Sequence]:
    """Sequences whose lengths are powers of two, the longest that the limits allow first."""
    out, left = [], list(reversed(pieces))
    while left:
        s, taken = Sequence(limits), []
        while left and s.segments and s.tokens:
            p = left.pop()
            if not (n := p.reach(s.tokens, s.loss)):
                left.append(p)
                break
            head, tail = p.cut(n)
            s.add(head)
            taken.append(head)
            if tail.size:
                left.append(tail)
        keep, s = 1 << (s.filled.bit_length() - 1), Sequence(limits)
        surplus = []
        for p in taken:
            head, tail = p.cut(min(p.size, keep - s.filled))
            if head.size:
                s.add(head)
            if tail.size:
                surplus.append(tail)
        left.extend(reversed(surplus))
        out.append(s)
    return out


def pack(items: Iterable[tuple[int, int, int]], limits: Limits, group: int, group_ids: int = 1 << 24) -> Iterator[Sequence]:
    """Packs (document, ids, first loss-bearing id), group pieces at a time, or as many as belong to documents of group_ids ids: a
    document is held until its last piece is placed."""
    held: list[Piece] = []
    sizes: dict[int, int] = {}
    pending = waiting = 0

    def close(last: bool) -> Iterator[Sequence]:
        nonlocal held, pending, waiting
        full, rest = fill(by_dot_product(held, limits), limits)
        yield from full
        kept = {p.doc for p in rest}
        if last or len(rest) > group // 2 or sum(sizes[d] for d in kept) > group_ids // 2:
            yield from powers(rest, limits)
            rest, kept = [], set()
        for d in [d for d in sizes if d not in kept]:
            del sizes[d]
        held, pending, waiting = rest, 0, sum(sizes.values())

    for doc, n, loss_from in items:
        sizes[doc] = n
        waiting += n
        p = Piece(doc, 0, n, loss_from)
        while p.size and (k := p.reach(limits.tokens, limits.loss)) < p.size:
            head, p = p.cut(k)
            if k == limits.tokens:
                s = Sequence(limits)
                s.add(head)
                yield s
            else:
                held.append(head)
                pending += 1
        if p.size:
            held.append(p)
            pending += 1
        if pending >= group or waiting >= group_ids:
            yield from close(False)
    yield from close(True)


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prompt_col: str | None = None, limits: Limits = Limits(), group: int = 768, group_bytes: int = 64 << 20, tokenizer_path: str | None = None
) -> DataFrame:
    """One row per piece. prompt_col: a text put before the document's, whose ids bear no loss (instruction data)."""
    path = tokenizer_path or bpe_chunks.default_path()
    arrow = pa.schema([pa.field(f.name, pa.int64()) for f in SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, numbered = TaskContext.get().partitionId(), 0
        ids: dict[int, bytes] = {}
        names: dict[int, int | None] = {}

        def items() -> Iterator[tuple[int, int, int]]:
            n = 0
            for b in batches:
                keys = b.column(0).to_pylist()
                texts = [t or "" for t in b.column(1).to_pylist()]
                prompts = [t or "" for t in b.column(2).to_pylist()] if prompt_col else [""] * len(keys)
                for key, prompt, text in zip(keys, prompts, texts, strict=True):
                    before = bpe_chunks.encode(path, prompt)
                    ids[n], names[n] = before + bpe_chunks.encode(path, text) + CLOSING_ID, key
                    yield n, len(ids[n]) // 4, len(before) // 4
                    n += 1

        left: dict[int, int] = {}
        rows: list[tuple] = []
        for s in pack(items(), limits, group, group_bytes // 4):
            at = 0
            for p in s.pieces:
                of = ids[p.doc]
                total = len(of) // 4
                rows.append((names[p.doc], p.start, p.size, zlib.crc32(of[4 * p.start : 4 * p.end]), total, pid * NUMBERS + numbered, at))
                at += p.size
                left[p.doc] = left.get(p.doc, total) - p.size
                if not left[p.doc]:
                    del left[p.doc], ids[p.doc], names[p.doc]
            numbered += 1
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=arrow)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(prompt_col).alias("prompt")] if prompt_col else [])
    return docs.select(*columns).mapInArrow(run, SCHEMA)
