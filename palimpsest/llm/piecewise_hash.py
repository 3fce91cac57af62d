"""Context-triggered piecewise hashing of whole texts and of texts edited with their successors.

A rolling hash over the last seven bytes ends a chunk where its low bits are all ones; each chunk gives one character, from
the rolling hashes inside it. A fingerprint is "size:signature:signature at twice the size". The block size is the
least power of two for which the text makes at most 64 blocks, halved while the signature stays short. Fingerprints
compare at equal block sizes, or where one size is twice the other, by edit distance (insertions and deletions);
signatures without a common run count as unlike.

The next document in the order of ids is found by one range-partitioned sort: inside a partition it is the next row; each
partition's first and last row are kept aside, a few rows a partition, and joined partition by partition.

Defined results: a null text is empty. Null ids come first; equal ids are ordered by the text's hash. A single row is its
own successor. Texts shorter than four code points are not edited. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, LENGTH, LEAST, RUN = 7, 64, 4, 7
#: Multipliers of the rolling and the chunk hash: odd, otherwise arbitrary.
ROLL, MIX = 0x01000193, np.uint32(0x9E3779B1)
#: Bytes hashed at once.
STRETCH = 1 << 22


def _rolling(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32) + np.uint32(1)
    r, power = x.copy(), ROLL
    for k in range(1, WINDOW):
        r[k:] += x[:-k] * np.uint32(power)
        power = power * ROLL % (1 << 32)
    r ^= r >> np.uint32(15)
    r *= MIX
    r ^= r >> np.uint32(13)
    return r


def _signature(ends: np.ndarray, sums: np.ndarray, total: int, n: int) -> str:
    """One character per chunk; what comes after the last that fits joins the final one."""
    ends = ends[: LENGTH - 1]
    at = np.concatenate([[0], sums[: len(ends)], [total] if not len(ends) or ends[-1] < n - 1 else []]).astype(np.uint32)
    parts = at[1:] - at[:-1]
    return ALPHABET[(parts * MIX) >> np.uint32(26)].tobytes().decode()


def fingerprint(raw: bytes, least: int = 0) -> str:
    """least: block sizes below it aren't looked at; texts of few different windows are hashed again with all."""
    n = len(raw)
    if not n:
        return f"{LEAST}::"
    size = LEAST
    while size * LENGTH < n:
        size *= 2
    floor = max(LEAST, least or size >> 4)
    data = np.frombuffer(raw, np.uint8)
    spots, sums, rolls, total = [], [], [], 0
    for start in range(0, n, STRETCH):  # bounded memory for very long texts
        lead = min(start, WINDOW - 1)
        r = _rolling(data[start - lead : start + STRETCH])[lead:]
        hit = np.flatnonzero((r & np.uint32(floor - 1)) == np.uint32(floor - 1))
        run = np.cumsum(r * (r | np.uint32(1)), dtype=np.uint32) + np.uint32(total)
        total = int(run[-1])
        spots.append(hit + start)
        sums.append(run[hit])
        rolls.append(r[hit])
    spot, run, roll = (np.concatenate(x) for x in (spots, sums, rolls))

    if len(spot) < LENGTH // 4 and floor > LEAST:
        return fingerprint(raw, LEAST)

    def at(block: int) -> tuple[np.ndarray, np.ndarray]:
        on = (roll & np.uint32(block - 1)) == np.uint32(block - 1)
        return spot[on], run[on]

    while size > floor and len(at(size)[0]) < LENGTH // 2:
        size //= 2
    return f"{size}:{_signature(*at(size), total, n)}:{_signature(*at(2 * size), total, n)}"


def _likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 - edit distance / summed lengths for each pair, 0 without a common run; bit-parallel over all pairs."""
    if not a:
        return np.zeros(0)
    la, lb = (np.array([len(x) for x in s]) for s in (a, b))
    wide = [np.frombuffer("".join(x.ljust(LENGTH, pad) for x in s).encode(), np.uint8).reshape(-1, LENGTH) for s, pad in ((a, " "), (b, "."))]
    same = np.packbits(wide[1][:, :, None] == wide[0][:, None, :], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    row = np.full(len(a), ~np.uint64(0))
    for j in range(LENGTH):
        hit = row & same[:, j]
        row = (row + hit) | (row - hit)
    common = LENGTH - np.bitwise_count(row).astype(int)
    need = np.minimum(np.minimum(la, lb), np.clip(np.minimum(la, lb) // 3, 2, RUN))
    longest, run, length = np.zeros(len(a), int), same, 0
    while length < RUN:
        longest[(run != 0).any(1)] = (length := length + 1)
        run = np.concatenate([np.zeros((len(a), 1), np.uint64), run[:, :-1] << np.uint64(1)], 1) & same
    score = 2 * common / np.maximum(la + lb, 1)
    return np.where((longest >= need) & (np.minimum(la, lb) > 0), score, 0.0)


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints; 1 for equal ones."""
    left, right, owner = [], [], []
    best = np.array([float(x == y) for x, y in pairs])
    for k, (x, y) in enumerate(pairs):
        if x == y:
            continue
        (sx, x1, x2), (sy, y1, y2) = x.split(":"), y.split(":")
        sx, sy = int(sx), int(sy)
        for ok, u, v in ((sx == sy, x1, y1), (sx == sy, x2, y2), (sx == 2 * sy, x1, y2), (sy == 2 * sx, x2, y1)):
            if ok:
                left.append(u)
                right.append(v)
                owner.append(k)
    for start in range(0, len(left), 1000):
        part = slice(start, start + 1000)
        np.maximum.at(best, owner[part], _likeness(left[part], right[part]))
    return best.tolist()


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as many code points from the start of the following one, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _results(items: list[tuple], following: list[tuple]) -> dict[str, list]:
    """items, following: (doc_id, text, fingerprint)."""
    changed = [edited(a[1], b[1]).encode() for a, b in zip(items, following, strict=True)]
    prints = [fingerprint(c) for c in changed]
    own = [a[2] for a in items]
    scores = likeness([*zip(own, prints, strict=True), *((a[2], b[2]) for a, b in zip(items, following, strict=True))])
    columns = [[a[0] for a in items], [len(a[1]) for a in items], [hashlib.sha256(c).hexdigest() for c in changed], own, prints, scores[: len(own)], scores[len(own) :]]
    return dict(zip(NAMES, columns, strict=True))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, at_once: int = 128) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in NAMES[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
    ends = {"part": None, "edge": None, "text": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), [], True

        def edge(item: tuple, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": item[0], "text": item[1], "fingerprint": item[2], "part": part, "edge": kind}], schema=kinds)

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                b = batch.slice(start, at_once)
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    text = text or ""
                    held.append((key, text, fingerprint(text.encode())))
                if first:
                    yield edge(held[0], 0)
                    first = False
                if len(held) > 1:
                    got = _results(held[:-1], held[1:])
                    yield pa.RecordBatch.from_pydict(got | {k: [v] * len(got["doc_id"]) for k, v in ends.items()}, schema=kinds)
                    held = held[-1:]
        if held:
            yield edge(held[0], 1)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            got = _results(list(zip(*c[:3], strict=True)), list(zip([None] * b.num_rows, *c[3:5], strict=True)))
            yield pa.RecordBatch.from_pydict(got, schema=pa.schema(list(kinds)[: len(NAMES)]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a hash breaks ties, so that rows of one id can be dealt over several partitions
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    walked = saved(ordered.mapInArrow(run, RESULT + ", part int, edge int, text string"), "walked")
    heads, tails = (walked.where(F.col("edge") == k).select("doc_id", "text", "fingerprint", "part") for k in (0, 1))
    # a row per partition, without texts
    order = Window.orderBy("part")
    nexts = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    after = heads.select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    seams = tails.join(nexts, "part").join(after, "following").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    return walked.where("edge is null").select(*NAMES).unionByName(seams.mapInArrow(close, RESULT))
