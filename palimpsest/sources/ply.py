"""Point clouds in PLY files: header and body are read file by file in tasks, text is written by Spark's text writer, binary files by
tasks that put their records at their offsets."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's scalar types, by both of their names.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}

#: The format's names of Spark's types.
NAMES = {"double": "double", "float": "float", "int": "int", "smallint": "short", "tinyint": "char"}


def vertices(raw: bytes) -> dict[str, np.ndarray]:
    """The vertex element's scalar properties. It must come first, as exporters write it."""
    head, found, body = raw.partition(b"end_header\n")
    if not found or not raw.startswith(b"ply"):
        raise ValueError("not a PLY file")
    lines = [line.split() for line in head.decode("ascii").splitlines()]
    form = next(line[1] for line in lines if line[:1] == ["format"])
    at = next(k for k, line in enumerate(lines) if line[:1] == ["element"])
    if lines[at][1] != "vertex":
        raise ValueError("the first element is not vertex")
    n, properties = int(lines[at][2]), []
    for line in lines[at + 1 :]:
        if line[:1] == ["element"]:
            break
        if line[:1] == ["property"]:
            properties.append((line[2], TYPES[line[1]]))
    if form == "ascii":
        rows = np.array(b" ".join(body.split(b"\n")[:n]).split(), float).reshape(n, -1)
        return {name: rows[:, k] for k, (name, _) in enumerate(properties)}
    order = "<" if form == "binary_little_endian" else ">"
    table = np.frombuffer(body, np.dtype([(name, order + kind) for name, kind in properties]), n)
    return {name: table[name] for name, _ in properties}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """file, vid, x, y, z of each vertex."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = vertices(raw)
                n = len(v["x"])
                for start in range(0, max(n, 1), 100_000):
                    part = slice(start, start + 100_000)
                    columns = {"file": pa.array([name] * len(v["x"][part]), pa.string()), "vid": pa.array(np.arange(n)[part], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | {c: pa.array(np.asarray(v[c][part], np.float64)) for c in "xyz"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, vid long, x double, y double, z double")


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """file, values: lines "name: number" of text files as a map."""
    pair = [F.regexp_extract("value", r"^\s*(\w+)\s*[:=]\s*(\S+)", k) for k in (1, 2)]
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), pair[0].alias("name"), pair[1].try_cast("double").alias("v")).where("name <> ''")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("values"))


def ascii_ply(points: DataFrame, n: int, coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Rows of text: number the header's lines first (ord), then the vertices by vid, for a sorted text write."""
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property double {c}" for c in coords], "end_header"]
    top = points.sparkSession.createDataFrame([(-len(head) + k, line) for k, line in enumerate(head)], "ord long, value string")
    return top.unionByName(points.select(F.col("vid").cast("long").alias("ord"), F.concat_ws(" ", *[F.col(c).cast("string") for c in coords]).alias("value")))


def write_binary(points: DataFrame, path: str, *, columns: Sequence[str] = ("x", "y", "z"), vid: str = "vid") -> int:
    """Writes one little-endian PLY of the points in ascending vid, and returns how many there are. path is a file that the driver and all
    executors see (a local one under a local master, a mounted folder on a cluster); it must not exist.

    Two passes: the points are sorted by ranges, and their number in each range gives each its place; then tasks, in any number and
    order, put records of fixed size at their offsets. A task that runs again writes the same bytes. The file has another name until it is whole.
    A null number of a floating type is NaN; a null of another type is an error."""
    from ..plans.scratch import saved

    if os.path.exists(path):
        raise FileExistsError(path)
    spark, names = points.sparkSession, list(columns)
    kinds = {c: NAMES[points.schema[c].dataType.simpleString()] for c in names}
    record = np.dtype([(c, "<" + TYPES[kinds[c]]) for c in names])
    ordered = points.select(vid, *names).repartitionByRange(vid).sortWithinPartitions(vid)
    # the id is the range's number above the row's place in it
    numbered = saved(ordered.withColumn("_at", F.monotonically_increasing_id()).select(F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"), *names), "cloud")
    counts = numbered.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # a row for each range
    n, starts = 0, {}
    for row in counts:
        starts[row["_range"]], n = n, n + row["n"]
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {kinds[c]} {c}" for c in names], "end_header", ""]).encode("ascii")
    staging = f"{path}.{uuid.uuid4().hex}"
    with open(staging, "xb") as f:
        f.write(head)
        f.truncate(len(head) + n * record.itemsize)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(staging, "r+b") as f:
            for b in batches:
                ranges, k = (b.column(c).to_numpy() for c in ("_range", "_k"))
                at = k + np.array([starts[x] for x in ranges], np.int64)
                rows = np.empty(len(at), record)
                for c in names:
                    column = b.column(c)
                    if column.null_count and not pa.types.is_floating(column.type):
                        raise ValueError(f"{c} is null")
                    rows[c] = column.to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                at, rows = at[order], rows[order]
                for s in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(s):
                        f.seek(len(head) + int(at[s[0]]) * record.itemsize)
                        f.write(rows[s].tobytes())
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(at)], pa.int64())})
            f.flush()
            os.fsync(f.fileno())

    written = numbered.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise OSError(f"{written} of {n} points were written")
    os.rename(staging, path)
    return n
