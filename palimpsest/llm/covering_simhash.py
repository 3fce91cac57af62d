"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is set if more than half of the hashes of the text's word shingles, repeats included, have it.
For radius r each bit position gets a nonzero vector of r + 1 bits, in turn; each of the 2 ** (r + 1) - 1 nonzero vectors
u makes a mask of the positions whose vector has an odd product with u. For any r differing positions some u is
orthogonal to all of them, so every pair within the radius agrees under some mask: it meets in that table's bucket.

Buckets of distinct fingerprints are linked inside tasks without making pairs: two fingerprints within distance 2 share
a number that differs from each by at most one bit, so each is sorted under its 64 one-bit neighbours and itself, and
runs of equal numbers are chained; for radius 1 only to the fingerprint that is the number itself. Only a spanning forest leaves the task.
A bucket with more fingerprints than fit is dealt again by masks over the bits outside its own mask, which leaves at most
a few thousand fingerprints together. Components come from alternating star rounds.

Defined results: a null text or one without words has fingerprint zero and is linked like any other; fewer words than
a shingle are one shingle. Rows with null ids are fingerprinted and linked, but name no component unless all of it is
null. Equal texts share everything. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LOWER, free_name, saved
from .lsm_dedup import BITMAP, FILTER_BITS, MOST_BITS, bitmap, bits_for, passing

#: Fingerprints of one bucket that one task takes, and of all buckets dealt to it on average.
BUCKET, SHARE = 50_000, 40_000
#: Ids that are broadcast as they are, 8 bytes each.
FEW = 1_000_000
ALL = (1 << 64) - 1


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    stops = ends[width - 1 :] or ends[-1:]
    for k in range(0, n, 1 << 16):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(simhash(t.as_py() or "", width, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(positions: list[int], radius: int) -> list[int]:
    """For every nonzero u, the positions whose vector has an odd product with u."""
    vectors = {p: 1 + k % ((2 << radius) - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p, v in vectors.items() if (u & v).bit_count() % 2) for u in range(1, 2 << radius)]


def _tables(kinds: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(kinds)])).alias("t")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what chains of steps within the radius connect."""
    fps = np.unique(fps)
    n = len(fps)
    own, parent = fps.view(np.uint64), list(range(n))
    near = np.concatenate([own, *[own ^ np.uint64(1 << k) for k in range(64)]])
    order = np.argsort(near, kind="stable")
    near = near[order]
    start = np.concatenate([[True], near[1:] != near[:-1]])
    lead = order[np.maximum.accumulate(np.where(start, np.arange(len(near)), 0))]  # the first of each run; a fingerprint itself comes before its neighbours
    other = ~start if radius == 2 else ~start & (lead < n)
    pairs = np.unique(np.stack([lead[other] % n, order[other] % n], 1), axis=0)
    out = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs.tolist():
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            out.append((int(fps[a]), int(fps[b])))
    return out


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET, share: int = SHARE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that join all within the radius, directly or by a chain."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    first = masks(list(range(64)), radius)
    placed = distinct.select("fp", _tables(first)).select("fp", "t.mask", "t.value")
    sizes = saved(placed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    met = placed.join(sizes, ["mask", "value"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(rows["fp"].to_numpy(np.int64), radius), columns=["u", "v"], dtype=np.int64)

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        """Buckets of n rows in all, some share of them a task."""
        tasks = max(1, -(-n // share))
        return rows.groupBy(F.pmod(F.xxhash64("mask", "value"), F.lit(tasks)).alias("task")).applyInPandas(link, "u long, v long")

    out = dealt(met.where(F.col("n") <= bucket).select("fp", "mask", "value"), total[0] or 0)
    if (total[1] or 0) > bucket:
        large = met.where(F.col("n") > bucket).select("fp", "mask")
        again = None
        for k, m in enumerate(first):
            finer = [m | x for x in masks([p for p in range(64) if not m >> p & 1], radius)]
            part = large.where(F.col("mask") == k).select("fp", _tables(finer)).select("fp", (F.col("t.mask") + 1000 * (k + 1)).alias("mask"), "t.value")
            again = part if again is None else again.unionByName(part)
        counts = saved(again.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "finer-buckets")
        n = counts.agg(F.sum("n")).first()[0] or 0  # up to as many times the rows as there are finer masks
        out = out.unionByName(dealt(again.join(counts, ["mask", "value"]).select("fp", "mask", "value"), n))
    return out.distinct()


def components(prints: DataFrame, radius: int = 2, *, bucket: int = BUCKET, share: int = SHARE) -> DataFrame:
    """doc_id, fp, component_id for rows of doc_id, fp: the smallest doc_id that links of at most radius bits reach."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = connected_components(links(distinct, radius, bucket, share), small=0)
    roots = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = saved(fingerprints(docs, id_col, text_col, width=width, seed=seed), "prints")
    return components(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without(docs: DataFrame, id_col: str, gone: DataFrame, *, most_bits: int = MOST_BITS, few: int = FEW) -> DataFrame:
    """docs without the rows whose id is among gone's (column key: distinct, not null, written). Null ids stay.

    A bitmap over the keys, of at most most_bits bits, tells most rows that stay. Ids that it takes for
    gone by chance are found from the id column alone; up to few of them are broadcast as well, so no text moves. Where
    there are more, only the rows that the bitmap marks are joined; where gone is too large for a bitmap, all rows are."""
    size, of = gone.count(), free_name(docs, "gone")
    exact = gone.select(F.col("key").alias(of))
    key = F.col(f"`{id_col}`").cast(gone.schema["key"].dataType)
    if size * FILTER_BITS > 8 * most_bits:
        return docs.join(exact, key == F.col(of), "left_anti")
    bits = min(most_bits, bits_for(size))
    marks = saved(bitmap(gone, bits), "marks")
    spared = saved(passing(docs.select(key.alias("key")).where("key is not null").distinct(), marks, bits).join(gone, "key", "left_anti"), "spared")
    place, word, stays = (free_name(docs, c) for c in ("place", "word", "stays"))
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = marks.select(F.col("bucket").alias(place), F.col("bits").alias(word))
    marked = docs.join(F.broadcast(words), F.floor(spot / BITMAP) == F.col(place), "left")
    byte = F.conv(F.hex(F.substring(F.col(word), (spot % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    clear = F.col(word).isNull() | key.isNull() | (F.call_function("shiftright", byte, (spot % 8).cast("int")) % 2 == 0)
    if spared.count() <= few:
        by_chance = F.broadcast(spared.select(F.col("key").alias(stays)))
        return marked.join(by_chance, key == F.col(stays), "left").where(clear | F.col(stays).isNotNull()).select(docs["*"])
    return marked.where(clear).select(docs["*"]).unionByName(marked.where(~clear).select(docs["*"]).join(exact, key == F.col(of), "left_anti"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """docs without those that are not their component's smallest id; of rows with equal ids all stay or go together."""
    near = near_duplicates(docs, id_col, text_col, radius=radius, width=width, seed=seed)
    gone = saved(near.where("component_id < doc_id").select(F.col("doc_id").alias("key")).distinct(), "gone")
    return without(docs, id_col, gone)
