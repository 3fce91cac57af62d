"""Line dedup over a sharded minimal perfect hash.

A line's key is the line stripped of blanks and with A-Z lower-cased. A 128-bit hash of every document's distinct keys
is counted, pre-aggregated per batch and per task. Hashes found in enough documents are dealt to shards by hash; each
shard builds a minimal perfect hash (levels of bit arrays in which a key keeps a bit that no other key of its level
shares; a key's slot is the rank of its bit) whose slots index an array of fingerprints, the hash's second half, and an
array of counts of 4 bytes, which stop at the largest such number. Documents then probe the arrays, and lines whose count
reaches the threshold go. Hashes counted fewer than index_from times, by default the threshold, aren't indexed: their lines
stay whatever their count, and a fingerprint of 64 bits tells them apart. An index of at most max_broadcast bytes, which is checked,
is broadcast; a larger one stays dealt over the cluster, and documents send it their hashes, one row per document and
shard, salted so that no shard meets all of them in one task.

Defined results: a null or empty text is one empty line; empty keys are never counted or dropped. A line repeated in a
document counts once there. A very long text is split and probed whole. Repeated rows count one by one. An empty table gives an empty result. The columns n_lines and
n_dropped replace input columns of these names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, LOWER, free_name, saved

#: Bits of a level per key; keys that a shard has on average at most.
GAMMA, SHARD_KEYS = 2.0, 1 << 17
#: Levels of a shard at most (a few dozen hold any shard of distinct keys), and the largest count that is told.
LEVELS, MOST_COUNTED = 500, (1 << 32) - 1

INDEX = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANKS) for line in text.translate(LOWER).split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two signed 64-bit numbers per key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)


def _long_enough(keys: list[bytes], min_chars: int) -> list[bool]:
    return [bool(k) and (min_chars <= 1 or len(k.decode()) >= min_chars) for k in keys]


def count_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """hi, lo, n: each distinct key's hash and the number of documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[bytes] = Counter()
            for raw in b.column(0).to_pylist():
                if raw:
                    keys = list(set(line_keys(raw)))
                    seen.update(xxhash.xxh3_128_digest(k) for k, ok in zip(keys, _long_enough(keys, min_chars), strict=True) if ok)
            h = np.frombuffer(b"".join(seen), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"hi": pa.array(h[:, 0]), "lo": pa.array(h[:, 1]), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "hi long, lo long, n long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _spots(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit of the level for each key; each level turns one half by another step, so that no two keys meet in all of them."""
    turn = np.uint64(level % 63 + 1)
    a = hi.view(np.uint64)
    a = (a << turn) | (a >> (np.uint64(64) - turn))
    x = lo.view(np.uint64) ^ a * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_shard(shard: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> dict:
    """Levels until each key has a bit of its own, then the arrays in the order of the bits."""
    sizes, bits, order = [], [], []
    left = np.arange(len(hi))
    while len(left):
        if len(sizes) > LEVELS:
            raise ValueError("keys of a shard are not distinct")
        size = max(64, int(GAMMA * len(left)))
        at = _spots(lo[left], hi[left], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        own = left[alone]
        order.append(own[np.argsort(at[alone])])
        sizes.append(size)
        bits.append(level)
        left = left[~alone]
    order = np.concatenate(order) if order else left
    return {
        "shard": shard,
        "sizes": sizes,
        "bits": np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool)).tobytes(),
        "fingerprints": lo[order].astype("<i8").tobytes(),
        "counts": np.minimum(n[order], MOST_COUNTED).astype("<u4").tobytes(),
    }


class Shard:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict) -> None:
        self.sizes = list(row["sizes"])
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.fingerprints = np.frombuffer(row["fingerprints"], "<i8")
        self.counts = np.frombuffer(row["counts"], "<u4")

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 for those that aren't indexed."""
        out, left, base = np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = base + _spots(lo[left], hi[left], level, size)
            on = self.bits[at]
            slot, who = self.rank[at[on]], left[on]
            same = self.fingerprints[slot] == lo[who]
            out[who[same]] = self.counts[slot[same]]
            left, base = left[~on], base + size
        return out


class Index:
    def __init__(self, rows: list[dict], shards: int) -> None:
        self.shards = shards
        self.parts = {r["shard"]: Shard(r) for r in rows}

    def probe(self, h: np.ndarray) -> np.ndarray:
        hi, lo = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        if self.shards == 1:
            return self.parts[0].probe(hi, lo) if 0 in self.parts else np.zeros(len(hi), np.int64)
        out, shard = np.zeros(len(hi), np.int64), hi % self.shards
        for s in np.unique(shard):
            if s in self.parts:
                out[shard == s] = self.parts[s].probe(hi[shard == s], lo[shard == s])
        return out


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([build_shard(key[0], *(rows[c].to_numpy(np.int64) for c in ("hi", "lo", "n")))])

    return counts.withColumn("shard", F.expr(f"cast(pmod(hi, {shards}L) as int)")).groupBy("shard").applyInPandas(build, INDEX)


def _kept(text: bytes, dropped: np.ndarray) -> bytes:
    lines = text.split(b"\n")
    gone = set(dropped.tolist())
    return b"\n".join(line for k, line in enumerate(lines) if k not in gone)


def _rebuilt(b: pa.RecordBatch, at: int, texts: list[bytes], n_lines: list[int], n_dropped: list[int], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(b.columns[: len(schema) - 2])
    columns[at] = pa.array([t.decode() for t in texts], pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)


def _raw(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def drop_common_lines(
    docs: DataFrame, text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1, max_broadcast: int = 32 << 20, shard_keys: int = SHARD_KEYS, index_from: int | None = None
) -> DataFrame:
    """docs, its texts without lines whose keys at least min_docs documents have, with n_lines (before) and n_dropped."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = pa.schema([(f.name, pa.null()) for f in schema])
    common = saved(count_lines(docs, text_col, min_chars).where(F.col("n") >= (min_docs if index_from is None else index_from)), "lines")
    shards = max(1, -(-common.count() // shard_keys))
    index = saved(build_index(common, shards), "index")
    size = index.agg(F.sum(F.length("bits") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0
    if size > max_broadcast:
        return _probe_dealt(docs, at, schema, names, index, shards, min_chars, min_docs)
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Index(held.value, shards)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = _raw(b.column(at))
                keys = [line_keys(t) for t in texts]
                ends = np.cumsum([len(k) for k in keys])
                flat = [k for own in keys for k in own]
                hits = (parts.probe(_hashes(flat)) >= min_docs) & np.array(_long_enough(flat, min_chars), bool)
                split = np.split(hits, ends[:-1])
                yield _rebuilt(b, at, [_kept(t, np.flatnonzero(h)) if h.any() else t for t, h in zip(texts, split, strict=True)], [len(h) for h in split], [int(h.sum()) for h in split], names)

    return docs.mapInArrow(run, schema)


PROBE = "shard int, salt int, kind int, row long, lines array<int>, hi array<long>, lo array<long>, sizes array<long>, bits binary, fingerprints binary, counts binary"


def _probe_dealt(docs: DataFrame, at: int, schema: T.StructType, names: pa.Schema, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes go to the shards, packed per document and shard; line numbers come back."""
    row, of, gone_lines, spark = free_name(docs, "row"), free_name(docs, "of"), free_name(docs, "lines"), docs.sparkSession
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    arrow = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("lines", pa.list_(pa.int32())), ("hi", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("bits", "fingerprints", "counts")]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                rows = []
                for text, n in zip(_raw(b.column(0).slice(start, 1000)), b.column(1).slice(start, 1000).to_pylist(), strict=True):
                    keys = line_keys(text)
                    h, ok = _hashes(keys), np.array(_long_enough(keys, min_chars), bool)
                    shard = np.where(ok, h[:, 0] % shards, -1)
                    rows += [{"shard": int(s), "salt": n % salts, "kind": 1, "row": n, "lines": (w := np.flatnonzero(shard == s)), "hi": h[w, 0], "lo": h[w, 1]} for s in np.unique(shard) if s >= 0]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            rows, lines = [], []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    shard, held = r["shard"], Shard(r)
                elif r["shard"] == shard:
                    hit = held.probe(np.array(r["hi"], np.int64), np.array(r["lo"], np.int64)) >= min_docs
                    if hit.any():
                        rows.append(r["row"])
                        lines.append(np.array(r["lines"], np.int32)[hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], names=["row", "lines"])

    asked = numbered.select(docs.columns[at], row).mapInArrow(ask, PROBE)
    shelves = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "sizes", "bits", "fingerprints", "counts")
    met = asked.unionByName(shelves, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    gone = met.mapInArrow(answer, "row long, lines array<int>").groupBy("row").agg(F.flatten(F.collect_list("lines")).alias(gone_lines)).withColumnRenamed("row", of)
    joined = numbered.join(gone, F.col(row) == F.col(of), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone_lines)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = _raw(b.column(at)), [np.array(x or [], np.int64) for x in b.column(b.num_columns - 1).to_pylist()]
            yield _rebuilt(b, at, [_kept(t, g) if len(g) else t for t, g in zip(texts, gone, strict=True)], [t.count(b"\n") + 1 for t in texts], [len(g) for g in gone], names)

    return joined.mapInArrow(finish, schema)
