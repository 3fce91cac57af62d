import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import orc_tokens, word_chunks
from palimpsest.llm.bpe_chunks import tokenizer

WORDS = ["the", "The", "it's", "don't", "1234", "naïve", "ΣΊΣΥΦΟΣ", "éte", "́x", "日本語", "<|endoftext|>", "a b", "x y", "\x1cz", "😀!?", "'ll", "İ", "ﬁ", "Ärger", "ŒUVRE", "ſt", "ı", "ŉ", "x²", "½", "a_b", "\x1f", "don't's", '."\'s', "\x85", "\xa0", "É", "ĲSsel", "×÷", "ªº", ""]


def _library(text):
    """Ids of the tokenizers library for the whole text, and the end id."""
    return [*tokenizer(word_chunks.default_path()).encode(text or "", add_special_tokens=False).ids, 1]


def _held(rows, docs):
    at = 0
    for row, (key, text) in zip(rows, docs, strict=True):
        ids = _library(text)
        assert tuple(row) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_encode_as_whole_texts():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(WORDS) + rng.choice(["", " ", "\n", "  ", "\t", "\r\n"]) for _ in range(rng.randrange(30)))
        assert word_chunks.encode(word_chunks.default_path(), text) == word_chunks.whole(word_chunks.default_path(), text)


def test_the_registered_query_against_the_library(spark):
    from palimpsest.llm.queries import op12_orc_tokens

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    rows = op12_orc_tokens(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    _held(rows, [tuple(d) for d in docs])


def test_edges(spark):
    schema = "doc_id long, text string, start string, part string, ids string"
    assert orc_tokens.round_trip(spark.createDataFrame([], schema)).count() == 0
    docs = [(None, "no id"), (1, None), (2, ""), (3, "word " * 200_000), (4, "tie"), (4, "tie"), (4, "tie")]
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], schema).repartition(3)
    rows = orc_tokens.round_trip(df).orderBy(F.col("start")).collect()
    _held(rows, docs)


def _numbers(spark, tmp_path, n=20_000):
    """Documents of even ids in several parts, with stripes small enough that a part has many."""
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.lit("number"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    path = f"{tmp_path}/tokens"
    orc_tokens.write(docs.repartition(7), path, stripe=200_000)
    return path


def _scanned(df):
    """Rows that the ORC scan of the tokens gave to the rest of the plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if p.nodeName().startswith("Scan orc") and "n_tokens" in p.schemaString() and "ids" in p.schemaString():
            out.append(p.metrics().apply("numOutputRows").value())
        it = p.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(plan)
    assert out
    return sum(out)


def test_readers_skip_by_index_and_filter(spark, tmp_path):
    path = _numbers(spark, tmp_path)
    whole = orc_tokens.read(spark, path)
    assert _scanned(whole) == 20_000
    one = orc_tokens.read(spark, path, doc_ids=[4444])
    assert one.count() == 1 and _scanned(one) <= 2 * orc_tokens.GROUP
    absent = orc_tokens.read(spark, path, doc_ids=[4445])  # within the ranges, so only the Bloom filters can tell
    assert absent.count() == 0 and _scanned(absent) == 0
    total = whole.agg(F.sum("n_tokens")).first()[0]
    low, high = total // 2, total // 2 + 500
    some = orc_tokens.read(spark, path, tokens=(low, high))
    want = {r.doc_id for r in whole.collect() if r.start < high and r.start + r.n_tokens > low}
    assert {r.doc_id for r in some.collect()} == want and len(want) > 2
    assert _scanned(some) <= 3 * orc_tokens.GROUP
    assert orc_tokens.read(spark, path, tokens=(total, total + 9)).count() == 0


def test_the_files_have_stripes_indexes_and_run_lengths(spark, tmp_path):
    from pyarrow import orc

    path = _numbers(spark, tmp_path)
    files = sorted(Path(path, "tokens").glob("*.orc"))
    stripes = [orc.ORCFile(str(f)) for f in files]
    assert sum(f.nrows for f in stripes) == 20_000 and max(f.nstripes for f in stripes) > 2
    assert {f.row_index_stride for f in stripes} == {orc_tokens.GROUP} and {f.file_version for f in stripes} == {"0.12"}
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(str(files[0]))
    reader = jvm.org.apache.orc.OrcFile.createReader(where, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    rows = reader.rows()
    footer = rows.readStripeFooter(reader.getStripes().get(0))
    kinds = {footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount())}
    codings = {footer.getColumns(k).getKind().toString() for k in range(footer.getColumnsCount())}
    rows.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and "DIRECT_V2" in codings
    # the same documents as plain 4-byte numbers, to tell what the encoding saves
    ids = sum(r.n_tokens for r in orc_tokens.read(spark, path).select("n_tokens").collect())
    assert sum(f.stat().st_size for f in files) < 4 * ids


def test_stripes_are_read_by_several_tasks(spark, tmp_path):
    path = _numbers(spark, tmp_path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150k")
        rows = orc_tokens.read(spark, path)
        tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > len(list(Path(path, "tokens").glob("*.orc"))) and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parts_and_a_folder_that_exists(spark, tmp_path):
    path = _numbers(spark, tmp_path)
    parts = orc_tokens.parts(spark, path).orderBy("part").collect()
    assert [p.first_token for p in parts] == [sum(q.n_tokens for q in parts[:k]) for k in range(len(parts))]
    assert sum(p.n_docs for p in parts) == 20_000
    with pytest.raises(Exception, match="(?i)exist"):
        _numbers(spark, tmp_path)
    assert json.loads(spark.read.orc(f"{path}/tokens").schema.json())["fields"][-1]["name"] == "ids"
