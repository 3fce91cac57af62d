"""Alignment of two tokenizers over exact-text deduplication: each distinct text is tokenised and aligned once.

Rows are grouped by their full text, pre-aggregated in the tasks, so that a text shared by any number of rows moves once a task. Each distinct
text is encoded by both tokenizers; where byte offsets meet, both cut the text, and between two neighbouring offsets of
either lies exactly one pair of overlapping tokens. The aligned table, written to the shared folder, has a row a text: its multiplicity,
measures, and distinct linked pairs of ids with their links. Pairs are counted over it, weighted by multiplicity, and the counts looked
up again: broadcast if the table of pairs has at most max_pairs rows, which is counted, else joined. Measures are joined to the rows by the
SHA-256 of their text. In both joins, keys of more than a thousandth of all rows, fewer than a thousand, are broadcast.

Defined results: a null text is empty; texts that are empty, or that a tokenizer does not give back byte for byte, have
no tokens: zeros, and an empty groups_sha256. Repeated rows are counted one by one and each returned. A very long text is encoded and
aligned whole, in memory in proportion to it. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_chunks, sp_chunks
from .common import saved

#: Rows of the table of pairs that are broadcast, some 20 bytes each.
MAX_PAIRS = 1 << 21
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, links array<int>"

_state: dict = {}


def _sized(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    return pieces, np.array(list(map(len, pieces)), np.int64)


def _pieces_a(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each entry, and how many these are."""
    if ("a", path) not in _state:
        enc = bpe_chunks.encoder(path)
        _state["a", path] = _sized([enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)])
    return _state["a", path]


def _pieces_b(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each piece: the marker is a space, a byte piece its byte."""
    if ("b", path) not in _state:
        sp = sp_chunks.processor(path)[0]
        names = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        _state["b", path] = _sized([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(sp_chunks.MARK, " ").encode() for i, p in names])
    return _state["b", path]


def _numbers(n: int) -> list[bytes]:
    """At 3 i, 3 i + 1 and 3 i + 2 the number i followed by a comma, a bar and a semicolon; n entries at least."""
    known = _state.setdefault("numbers", [])
    known += [b"%d%c" % (k // 3, b",|;"[k % 3]) for k in range(len(known), n)]
    return known


@dataclass(frozen=True)
class Alignment:
    """Ids and byte ends of both sides, how many ends of each side there are up to a byte offset, the ends that they share, and for each
    link the index of its token on either side."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    upto_a: np.ndarray
    upto_b: np.ndarray
    shared: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def groups(self) -> bytes:
        """a1,a2|b1;a3|b2,b3: the ids between the ends that both share."""
        # how many groups end before each token's end, and how many tokens of the other side stand before it
        ends = np.zeros(len(self.upto_a), bool)
        ends[self.shared] = True
        groups = np.cumsum(ends)
        group_a, group_b = groups[self.ends_a - 1], groups[self.ends_b - 1]
        parts = np.empty(len(self.a) + len(self.b), np.int64)
        # a number is told with what follows it: a comma, or what ends its side of the group
        parts[np.arange(len(self.a)) + np.concatenate([[0], self.upto_b[self.shared]])[group_a]] = 3 * self.a + ends[self.ends_a]
        parts[np.arange(len(self.b)) + self.upto_a[self.shared][group_b]] = 3 * self.b + 2 * ends[self.ends_b]
        return b"".join(map(_numbers(int(parts.max()) + 1).__getitem__, parts.tolist()))[:-1]


def align(path_a: str, path_b: str, text: str) -> Alignment | None:
    """None if the text is empty or a tokenizer does not give it back."""
    if not text:
        return None
    want = (" " + text).encode()
    a = np.frombuffer(bpe_chunks.encode(path_a, " " + text), "<u4").astype(np.int64)
    b = np.frombuffer(sp_chunks.encode(path_b, text), "<u4")[1:-1].astype(np.int64)
    (pieces_a, sizes_a), (pieces_b, sizes_b) = _pieces_a(path_a), _pieces_b(path_b)
    if b"".join(map(pieces_a.__getitem__, a.tolist())) != want or b"".join(map(pieces_b.__getitem__, b.tolist())) != want:
        return None
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    in_a, in_b = (np.zeros(len(want) + 1, bool) for _ in "ab")
    in_a[ends_a], in_b[ends_b] = True, True
    upto_a, upto_b, cuts = np.cumsum(in_a), np.cumsum(in_b), np.flatnonzero(in_a | in_b)
    return Alignment(a, b, ends_a, ends_b, upto_a, upto_b, np.flatnonzero(in_a & in_b), upto_a[cuts - 1], upto_b[cuts - 1])


def aligned_texts(docs: DataFrame, text_col: str = "text", *, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row per distinct text: its digest, multiplicity and measures, and its distinct pairs of linked ids with their links."""
    path_a, path_b = path_a or bpe_chunks.default_path(), path_b or sp_chunks.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                texts, counts = (c.to_pylist() for c in batch.slice(first, 64).columns)
                rows = []
                for text, n in zip(texts, counts, strict=True):
                    digest, found = hashlib.sha256(text.encode()).digest(), align(path_a, path_b, text)
                    if found is None:
                        rows.append((digest, n, 0, 0, 0, 0, "", [], [], []))
                        continue
                    keys, links = np.unique(found.a[found.link_a] << 32 | found.b[found.link_b], return_counts=True)
                    sha = hashlib.sha256(found.groups()).hexdigest()
                    rows.append((digest, n, len(found.a), len(found.b), len(found.shared), len(found.link_a), sha, keys >> 32, keys & 0xFFFFFFFF, links))
                kinds = [pa.binary(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ALIGNED.split(", ")])

    distinct = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    return distinct.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n, best: in how many rows of the corpus a pair of ids is linked, and whether that is the most of its a."""
    pairs = aligned.select("n", F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
    pairs = saved(pairs, "pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("_most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str, share: int = 1000) -> DataFrame:
    """rows joined to table, whose n tells how many rows a key has; the frequent keys' rows stay where they are."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * share > total
    often = table.where(hot)  # fewer than share rows
    met = rows.join(F.broadcast(often), list(keys))
    return met.unionByName(rows.join(F.broadcast(often.select(*keys)), list(keys), "left_anti").join(table.where(~hot), list(keys)))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path_a: str | None = None, path_b: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = saved(aligned_texts(docs, text_col, path_a=path_a, path_b=path_b), "aligned")
    counts = saved(pair_counts(table), "pair-counts")
    linked = table.select("digest", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("digest", "p.*")
    told = counts.select("a", "b", F.col("n").alias("pair_n"), "best")
    met = linked.join(F.broadcast(told), ["a", "b"]) if counts.count() <= max_pairs else _looked_up(linked, told, ["a", "b"], "pair_n")
    sums = met.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("links") * F.col("pair_n")).alias("count_sum"))
    told = table.select("digest", "n", *MEASURES, "groups_sha256").join(sums, "digest", "left").na.fill(0, ["n_best", "count_sum"])
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest")), "digests")
    return _looked_up(rows, saved(told, "measures"), ["digest"], "n").select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")
