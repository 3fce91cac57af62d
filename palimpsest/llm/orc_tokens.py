"""Token ids in ORC files: documents in ascending order of their id, found again by metadata alone.

Layout of a folder: tokens holds the documents (part, doc_id, start and stop in the part, n_tokens, ids), a file a part, parts in order; parts holds a
row a part with its first token and document. Integers are run-length encoded (version 2), which packs ids in the bits they
need. Every thousand rows have an entry in the row index with the least and greatest values, and a Bloom filter on doc_id; readers skip the
stripes and row groups that these exclude, and split a file at its stripes.

Texts are dealt by ranges of doc_id, so only they move, and are encoded in order while the files are written: a task holds a batch and a
stripe. Places of parts come from the files (two integer columns), never from a count kept on the side, so a part that is
written again by another executor is counted once.

Defined results: a null text is empty and has the end id alone. Rows of a null id come first. Rows of one id stand in the order of
their texts; they may lie in several parts, since a range is cut by the row where an id repeats. A very long text is one
row, encoded whole; its ids are an array, so it may have 2^31 at most. An empty table gives files without rows. Columns other than the id and the text are not read. Nothing is overwritten: a folder that
exists is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import word_chunks
from .common import scratch

#: Rows of a row group, the least that the format allows; bytes of a stripe; false positives of a Bloom filter.
GROUP, STRIPE, FALSE = 1000, 16 << 20, 0.01
SCHEMA = "part int, doc_id long, start long, stop long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, end_id: int = 1, stripe: int = STRIPE) -> None:
    """Writes the documents' ids, each with the end id after it, into a new folder."""
    vocabulary, end = tokenizer_path or word_chunks.default_path(), np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the row's number is last, so that even equal rows can be dealt to several parts
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                b = batch.slice(first, 256)
                ids = [word_chunks.encode(vocabulary, t) + end for t in b.column(1).to_pylist()]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns = [pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(at + ends - n), pa.array(at + ends), pa.array(n), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "stop", "n_tokens", "ids"])
                at += int(ends[-1])

    # a stripe's size is looked at every hundred rows, since a row may be long
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE), "orc.row.index.stride": str(GROUP), "orc.create.index": "true", "orc.stripe.size": str(stripe), "orc.rows.between.memory.checks": "100", "compression": "zstd"}
    placed.mapInArrow(run, SCHEMA).write.options(**options).orc(f"{path}/tokens")
    spark = docs.sparkSession
    found = spark.read.schema(SCHEMA).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
    firsts = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_tokens", "first_token"), ("n_docs", "first_doc"))]
    found.select("part", "n_tokens", "n_docs", *firsts).write.orc(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """part, n_tokens, n_docs, first_token, first_doc."""
    return spark.read.schema("part int, n_tokens long, n_docs long, first_token long, first_doc long").orc(f"{path}/parts")


def read(spark: SparkSession, path: str, *, doc_ids: Sequence[int] | None = None, tokens: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. doc_ids: of these documents; tokens: of those with a token in this range of the whole sequence.
    Both conditions reach the files' statistics and filters."""
    rows, at = spark.read.schema(SCHEMA).orc(f"{path}/tokens"), parts(spark, path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids))
    if tokens is not None:
        low, high = tokens
        near = at.where((F.col("first_token") < high) & (F.col("first_token") + F.col("n_tokens") > low))
        inside = F.lit(False)
        edges = near.agg(F.min(F.struct("part", "first_token")), F.max(F.struct("part", "first_token"))).first()
        if edges[0] is not None:
            (p, first), (q, last) = edges
            # all of the parts between, and of those at the ends only what the range reaches
            inside = F.col("part").between(p, q) & ((F.col("part") > p) | (F.col("stop") > low - first)) & ((F.col("part") < q) | (F.col("start") < high - last))
        rows = rows.where(inside)
    met = rows.join(at.select("part", "first_token"), "part")
    return met.select("doc_id", (F.col("first_token") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: rows as read, with the checksum of their ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """checksums of what the files hold, after writing them to the shared folder."""
    path = scratch(docs.sparkSession, "orc-tokens")
    write(docs, path, id_col, text_col, tokenizer_path=tokenizer_path, end_id=end_id)
    return checksums(read(docs.sparkSession, path))
