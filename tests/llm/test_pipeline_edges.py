"""The pipeline's stages on empty tables, clashing columns, repeated rows, nulls and very long texts; its result against a plain version."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm.common import BLANKS, LOWER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "n_lines long, score double, pii_email int, gone boolean, place int, bits long"
WORDS = {"aa": "der die und nicht ist ein haus garten wasser".split(), "bb": "the and not with house garden water over".split()}


def _docs(n=120):
    import random

    r = random.Random(21)
    out = []
    for k in range(n):
        lang = r.choice(["aa", "bb"])
        lines = [" ".join(r.choice(WORDS[lang]) for _ in range(12)) for _ in range(4)] + (["Shared line of many"] if k % 3 == 0 else [])
        out.append((k, "\n".join(lines), lang, "s", 0))
    out += [(200, out[5][1], "aa", "s", 0), (201, None, "aa", "s", None), (202, "", "bb", "s", 0), (203, "1234 5678", "bb", "s", 0)]
    out += [(204, "wasser " * 60_000, "aa", "s", 0), (5, out[5][1], "aa", "s", 0), (None, "the house and the garden with water over the house", "bb", "s", 1)]
    return out


def _table(spark, rows):
    return spark.createDataFrame([(*d, 1, 0.5, 2, True, 3, 4) for d in rows], f"{DOCS}, {CLASHES}")


def _stages(spark, rows):
    """The outputs of all stages, each fed with the one before."""
    docs, out = _table(spark, rows), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_an_empty_table(spark):
    names = [c.split()[0] for c in f"{DOCS}, {CLASHES}".split(", ")]
    *texts, packed = _stages(spark, [])
    assert all(t.columns == names and t.count() == 0 for t in texts) and packed.count() == 0


def test_stages_on_clashing_columns_repeats_nulls_and_long_texts(spark):
    rows = _docs()
    language, lines, near, private, packed = _stages(spark, rows)
    first = {(r.doc_id, r.text) for r in language.collect()}
    assert not {201, 202, 203} & {k for k, _ in first} and (204, rows[124][1]) in first and sum(r.doc_id == 5 for r in language.collect()) == 2
    # lines: a key of ten documents goes everywhere
    key = lambda line: line.encode().translate(LOWER).strip(BLANKS)
    held = [(r.doc_id, (r.text or "").split("\n")) for r in language.collect()]
    count = Counter(k for _, ls in held for k in {key(x) for x in ls} - {b""})
    want = sorted(((i, "\n".join(x for x in ls if count[key(x)] < 10)) for i, ls in held), key=repr)
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    # one document of each group of equal texts stays, with all rows of its id, and nothing that is alone goes
    texts = {r.text for r in lines.collect()}
    assert Counter(t for _, t in {(r.doc_id, r.text) for r in near.collect()}) == Counter(dict.fromkeys(texts, 1))
    assert sum(r.doc_id == 5 for r in near.collect()) == 2 and not any(r.doc_id == 200 for r in near.collect())
    assert all((r.n_lines, r.score, r.gone, r.place, r.bits) == (1, 0.5, True, 3, 4) for r in private.collect())
    assert {r.doc_id: r.text for r in private.collect()} == {r.doc_id: r.text for r in near.collect()}  # nothing private in these
    assert any(r.doc_id is None for r in private.collect())
    # packing: the pieces of a document are its ids in order, once
    from palimpsest.llm import bpe_chunks

    pieces = {}
    for p in packed.collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    for r in {r.doc_id: r for r in private.collect() if r.doc_id not in (5, None)}.values():
        ids, at = bpe_chunks.whole(bpe_chunks.default_path(), r.text) + b"\0\0\0\0", 0
        for start, length, crc in sorted(pieces[r.doc_id]):
            assert start == at and crc == zlib.crc32(ids[4 * at : 4 * (at + length)])
            at += length
        assert 4 * at == len(ids)
    filled = Counter()
    for p in packed.collect():
        filled[p.sequence_id] += p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in filled.values())


def test_private_values_are_replaced_in_the_stage(spark):
    rows = [(k, f"the house {k} and garden, mail name{k}@example.org or 4111111111111111 at 10.0.0.{k}", "bb", "s", 0) for k in range(40)]
    stage = dict(corpus_pipeline.STAGES)["pii"]
    got = stage(spark, _table(spark, rows), "").collect()
    assert len(got) == 40 and not any(re.search(rf"name{r.doc_id}@|4111111111111111|10\.0\.0\.{r.doc_id}\b", r.text) for r in got)
    assert len({re.search(r"or (\d{16})", r.text)[1] for r in got}) == 1  # equal values stay linked
    assert all(r.n_chars == len(r.text) for r in got)


def test_run_writes_and_rereads_each_stage(spark, tmp_path):
    spark.createDataFrame([(k, *d[1:]) for k, d in enumerate(_docs(60))], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in "ab")
    assert {x[0] for x in a} == {x[0] for x in b} and a and hashlib.sha256(repr(sorted({x[0] for x in a})).encode()).hexdigest()
    assert pytest.approx(sum(x[2] for x in a)) == sum(x[2] for x in b)
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.col("text").isNull()).count() == 1
