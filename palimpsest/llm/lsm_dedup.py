"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Digests go into memtables: each task sorts its rows and flushes at most MEMTABLE of them as one run, a Parquet file whose
Bloom filter and sorted row groups let a lookup skip it. A batch's runs are compacted into a tier, one entry per digest with
the smallest identifier and the count, and a bitmap filter over its digests, FILTER_BITS a digest. A table comes in batches of whole
runs, BATCHES of them or as many as BATCH_ROWS rows each make, but no more than it has runs. A new batch is looked up in
the older tiers: only digests that pass a tier's filter are joined with it, and a tier that none passes is not read. When
fan tiers are within a factor of fan of each other they are compacted into one.

A digest that a batch has twice, or that its lookup finds in an older tier, is a hit; in the end the tiers are asked for the hits' smallest
identifiers and counts, and no other digest is touched again. Hits receive byte verification: a bitmap over them, sized by their number,
lets the second reading of the texts pass by most other rows, and the least and the greatest text of each digest,
pre-aggregated before the shuffle, must be the same bytes. Rows of digests for which they differ are grouped by bytes.
Bitmaps are at most MOST_BITS (16 MB), a bound of what is broadcast; where hits need more, digests are joined instead.
Digests that have a thousandth of all rows, fewer than a thousand, are broadcast to their rows, so none meets in one task.

Defined results: a null text counts as empty. Null ids come after all others. Of rows that share both text and smallest
id exactly one is kept. An empty table gives an empty result. Repeated rows are rows of their own. A very long text is
normalised and hashed whole. Input columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bits of one bitmap row, as bitmap_construct_agg lays it out; bits of a filter per key, and of a filter at most.
BITMAP, FILTER_BITS, MOST_BITS = 1 << 15, 16, 1 << 27
#: Rows of a run; batches at least, and rows of one at most.
MEMTABLE, BATCHES, BATCH_ROWS = 1_000_000, 4, 1 << 30
#: Rows that one task can number: monotonically_increasing_id counts from the task's number times this.
TASK = 1 << 33
#: The filters of a run: Parquet's own, on the key.
RUN = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000", "maxRecordsPerFile": str(MEMTABLE)}


def normalised(text: Column) -> Column:
    """Every run of blanks as one space. Single spaces, most runs, need no replacement and don't match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _key(digest: Column, key_bytes: int) -> Column:
    return digest if key_bytes >= 32 else F.substring(digest, 1, key_bytes)


def _least() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32) -> DataFrame:
    """Level 0: (row, doc_id, digest, key), each task's rows as one run sorted by key, the digest's first key_bytes bytes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _digest(normalised(F.col(text_col))).alias("key"))
    if key_bytes < 32:
        rows = rows.select("row", "doc_id", F.col("key").alias("digest"), _key(F.col("key"), key_bytes).alias("key"))
    return saved(rows.sortWithinPartitions("key"), "runs", **RUN)


def compact(runs: DataFrame) -> DataFrame:
    """Level 1: of runs (or of several levels 0, unioned) one entry per key: key, keep, n."""
    return saved(runs.groupBy("key").agg(_least().alias("keep"), F.count("*").alias("n")).sortWithinPartitions("key"), "level", **RUN)


def bits_for(keys: int) -> int:
    """Bits of a filter over so many keys: a power of two."""
    return min(MOST_BITS, max(BITMAP, 1 << (max(1, keys) * FILTER_BITS - 1).bit_length()))


def bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """A filter over the keys, of bits bits: one row for each 2 ** 15 of them that has any set."""
    spots = keys.select(F.expr(f"pmod(xxhash64(key), {bits}L)").alias("spot"))
    return spots.groupBy(F.expr(f"spot div {BITMAP}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"spot % {BITMAP}")).alias("bits"))


def passing(rows: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be one of a filter's, which is broadcast: bits / 8 bytes."""
    spots = rows.withColumn("spot", F.expr(f"pmod(xxhash64(key), {bits}L)")).withColumn("bucket", F.expr(f"spot div {BITMAP}"))
    bit = F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(spot % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int), cast(spot % 8 as int)) & 1")
    return spots.join(F.broadcast(filter_), "bucket").where(bit == 1).select(*rows.columns)


@dataclass
class Tier:
    """Compacted entries (key, keep, n), their number, and their filter."""

    level: DataFrame
    size: int
    filter: DataFrame | None
    bits: int


class Index:
    """Tiers of digests, the oldest first. reads counts the tiers that lookups have read, merges the compactions of tiers."""

    def __init__(self, fan: int = 4) -> None:
        self.fan, self.tiers, self.reads, self.merges = fan, [], 0, 0

    def _tier(self, level: DataFrame, size: int) -> Tier:
        bits = bits_for(size)
        full = size * FILTER_BITS > 8 * MOST_BITS  # such a filter would pass nearly all
        return Tier(level, size, None if full else saved(bitmap(level, bits), "filter"), bits)

    def add(self, runs: DataFrame) -> DataFrame:
        """Compacts a batch's runs into a tier, and tiers into larger ones. Returns the batch's own level."""
        return self.insert(compact(runs))

    def insert(self, level: DataFrame) -> DataFrame:
        """Adds a compacted level as the newest tier."""
        self.tiers.append(self._tier(level, level.count()))
        while len(self.tiers) >= self.fan and self.tiers[-self.fan].size <= self.fan * max(1, self.tiers[-1].size):
            old = self.tiers[-self.fan :]
            union = old[0].level
            for t in old[1:]:
                union = union.unionByName(t.level)
            whole = saved(union.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")).sortWithinPartitions("key"), "level", **RUN)
            self.tiers[-self.fan :] = [self._tier(whole, whole.count())]
            self.merges += 1
        return level

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """key, keep, n of those of the distinct keys that the index has; None if no tier had to be read."""
        found = None
        for t in self.tiers:
            asked = saved(keys.select("key") if t.filter is None else passing(keys.select("key"), t.filter, t.bits), "asked")
            if asked.isEmpty():
                continue
            self.reads += 1
            met = t.level.join(asked, "key")
            found = met if found is None else found.unionByName(met)
        return found and found.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def candidates(texts: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """The rows of texts whose key may be a hit."""
    bits = bits_for(n_hits)
    if n_hits * FILTER_BITS > 8 * bits:
        return texts.join(hits.select("key"), "key", "left_semi")
    return passing(texts, bitmap(hits, bits), bits)


def batches(runs: DataFrame, n_rows: int, newest: int) -> list[DataFrame]:
    """The runs in batches: neighbouring tasks' rows, told by the rows' numbers, by which Parquet skips the others' files."""
    tasks = newest // TASK + 1
    n = min(tasks, max(BATCHES, -(-n_rows // BATCH_ROWS)))
    cuts = [tasks * k // n * TASK for k in range(n + 1)]
    return [runs.where((F.col("row") >= a) & (F.col("row") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def indexed(runs: DataFrame, index: Index) -> tuple[DataFrame, int, int]:
    """Feeds the runs to the index batch by batch. Its hits (key, keep, n), and how many rows and hits there are."""
    n_rows, newest = runs.agg(F.count("*"), F.max("row")).first()
    found = runs.select("key").limit(0)
    for batch in batches(runs, n_rows, newest or 0):
        level = compact(batch)
        met = index.lookup(level)
        twice = level.where("n > 1").select("key")
        found = found.unionByName(saved(twice if met is None else twice.unionByName(met.select("key")), "hits"))
        index.insert(level)
    keys = saved(found.distinct(), "hit-keys")
    told = index.lookup(keys)
    hits = saved(told if told is not None else index.tiers[-1].level.limit(0), "hits")
    return hits, n_rows, hits.count()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bytes: int = 32, share: int = 1000, index: Index | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, digest (of the normalised text).

    key_bytes shortens the index's keys; results stay exact, as byte verification finds texts that share a key. index: an empty one, to be
    filled."""
    runs = flush(docs, id_col, text_col, key_bytes)
    hits, n_rows, n_hits = indexed(runs, index or Index())
    text = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("digest", _digest(F.col("norm")))
    texts = texts.withColumn("key", _key(F.col("digest"), key_bytes))
    ends = candidates(texts.select("key", "norm"), hits, n_hits).groupBy("key").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clashes = saved(ends.where("low <> high").select("key"), "clashes")
    digest = "key" if key_bytes >= 32 else "digest"
    hot = hits.where(F.col("n") * share > n_rows)  # fewer than share keys
    few, many = runs.join(F.broadcast(hot), "key"), runs.join(F.broadcast(hot.select("key")), "key", "left_anti")
    rows = many.join(hits.where(F.col("n") * share <= n_rows), "key", "left").unionByName(few)
    out = rows.select(
        "doc_id",
        F.coalesce("keep.doc_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("keep.row").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col(digest).alias("digest"),
        "key",
    )
    if clashes.isEmpty():
        return out.drop("key")
    torn = saved(texts.join(clashes, "key", "left_semi").select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "key", "norm"), "torn")
    classes = torn.groupBy("key", "norm").agg(_least().alias("keep"), F.count("*").alias("n"))
    mended = torn.join(classes, ["key", "norm"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.row") == F.col("row")).alias("kept"), "digest")
    return out.join(clashes, "key", "left_anti").drop("key").unionByName(mended)
