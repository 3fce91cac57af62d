"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold the whitespace marker only in front (pieces are checked for it), so no merge crosses the
border between a character and a following marker, and a text's ids are those of its marked words in order. Ids and texts
come from the library, begin and end ids included, and equal those of encoding whole texts. A text that holds the marker
character itself is one chunk.

by_table builds the table of distinct chunks over the whole corpus, written to the shared folder: each is segmented once, and
its ids are joined back to the documents' positions. Chunks of a thousandth of all rows, fewer than a thousand, are broadcast to
their rows. That moves a row per document and distinct word twice. round_trip moves nothing: each worker keeps a bounded
table of its own, segments each of its words once and joins ids by position in place; a word too long for it is
segmented where it stands.

Defined results: a null text is empty and gives the begin and end ids. An empty table gives an empty result. Repeated
rows repeat. A very long text is encoded whole. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MARK = "▁"
#: Words in a worker's table, and the longest of them.
TABLE, LONGEST = 500_000, 64
#: Spaces and the word after them.
MARKED = re.compile(" +[^ ]*")

_state: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """The table: a marked word, without the first of its markers, and its ids. The library writes one marker itself."""

    def __init__(self, sp) -> None:
        self.sp = sp
        self.alone = packed([sp.piece_to_id(MARK)])

    def __missing__(self, word: str) -> bytes:
        ids = packed(self.sp.encode(word)) if word else self.alone
        if len(word) <= LONGEST:
            if len(self) >= TABLE:
                self.clear()
            self[word] = ids
        return ids


def processor(path: str):
    """The library's processor, whether words can be cut apart, and the table of words, once per worker."""
    if path not in _state:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        _state[path] = sp, not any(MARK in p.lstrip(MARK) for p in pieces), _Words(sp)
    return _state[path]


def chunks(path: str, text: str) -> list[str] | None:
    """The text's marked words, each without the first of its markers; None if it is to be encoded whole."""
    if not text or not processor(path)[1] or MARK in text:
        return None
    words = text.split(" ")
    return [w[1:] for w in MARKED.findall(" " + text)] if "" in words else words


def encode(path: str, text: str) -> bytes:
    """The text's ids, begin and end included, as little-endian unsigned 32-bit integers."""
    sp, _, table = processor(path)
    begin, end = packed([sp.bos_id()]), packed([sp.eos_id()])
    words = chunks(path, text)
    return b"".join([begin, packed(sp.encode(text)), end] if words is None else [begin, *map(table.__getitem__, words), end])


def decode(path: str, ids: list[bytes]) -> list[str]:
    return processor(path)[0].decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1) if ids else []


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _schema(with_ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids


def _told(path: str, keys: pa.Array, ids: list[bytes], with_ids: bool) -> pa.RecordBatch:
    texts = decode(path, ids)
    columns = {
        "doc_id": keys,
        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
        "ids_sha256": pa.array([_sha(i) for i in ids], pa.string()),
        "decoded_sha256": pa.array([_sha(t.encode()) for t in texts], pa.string()),
    }
    if with_ids:
        columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids (little-endian bytes) and the text."""
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                yield _told(path, b.column(0), [encode(path, t or "") for t in b.column(1).to_pylist()], with_ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _schema(with_ids))


def occurrences(rows: DataFrame, path: str) -> DataFrame:
    """row, whole, chunk, at: each row's distinct chunks and their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                b = batch.slice(start, 128)
                out: list[tuple] = []
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = chunks(path, text or "")
                    at: dict[str, list[int]] = {}
                    for k, w in enumerate([text or ""] if words is None else words):
                        at.setdefault(w, []).append(k)
                    out += [(row, words is None, w, p) for w, p in at.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32())))], names=["row", "whole", "chunk", "at"])

    return rows.select("row", "text").mapInArrow(run, "row long, whole boolean, chunk string, at array<int>")


def chunk_table(found: DataFrame, path: str) -> DataFrame:
    """whole, chunk, n, ids: each distinct chunk, how many rows have it, and its ids."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _, table = processor(path)
        for b in batches:
            ids = [packed(sp.encode(c)) if c or whole else table.alone for whole, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=["whole", "chunk", "n", "ids"])

    distinct = found.groupBy("whole", "chunk").agg(F.count("*").alias("n"))
    return distinct.mapInArrow(segment, "whole boolean, chunk string, n long, ids binary")


def by_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_path: str | None = None, with_ids: bool = False, share: int = 1000) -> DataFrame:
    """round_trip's result by one table of distinct chunks for the whole corpus."""
    path = model_path or default_path()
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "rows")
    found = saved(occurrences(rows, path), "chunks")
    table = saved(chunk_table(found, path), "table")
    total = table.agg(F.sum("n")).first()[0] or 0
    key, hot = ["whole", "chunk"], F.col("n") * share > total
    often = table.where(hot).select(*key, "ids")
    few = found.join(F.broadcast(often), key)
    many = found.join(F.broadcast(often.select(*key)), key, "left_anti").join(table.where(~hot).select(*key, "ids"), key)
    own = few.unionByName(many).groupBy("row").agg(F.collect_list(F.struct("at", "ids")).alias("parts"))  # one text's chunks
    met = rows.select("row", "doc_id").join(own, "row", "left").select("doc_id", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)[0]
        begin, end = packed([sp.bos_id()]), packed([sp.eos_id()])
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                b = batch.slice(start, 128)
                ids = []
                for parts in b.column(1).to_pylist():
                    placed = sorted((k, p["ids"]) for p in parts for k in p["at"])
                    ids.append(b"".join([begin, *(i for _, i in placed), end]))
                yield _told(path, b.column(0), ids, with_ids)

    return met.mapInArrow(run, _schema(with_ids))
