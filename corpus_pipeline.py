"""Documents to packed training sequences in five stages, each written as Parquet and read again.

Language ID rejects documents without a known language, lines that many documents share go, one document of each SimHash
group stays, personal data becomes pseudonyms, and what is left is packed. All stages but the last return the columns
of documents; n_chars follows the text where a stage changes it.

Nulls, empty and very long texts and ties are what the operators state: a text that is null or has no letter goes with the first stage,
long ones are worked on whole. Rows of one id stay or go together. An empty table stays empty. Other columns keep their names,
order and values, whatever they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import covering_simhash, language_id, line_dedup, pseudonyms, vector_packing
from palimpsest.llm.common import OPEN_KEY, saved


def _apart(docs: DataFrame, change: Callable[[DataFrame], DataFrame], *, texts: bool = False) -> DataFrame:
    """What change leaves of docs, whose other columns are out of its sight under names of our own. texts: it changes the texts, and
    n_chars is their length."""
    hidden = {c: f"column {k} of documents" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    out = change(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]))
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return out.select(*[length.alias(c) if texts and c == "n_chars" else F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, language_id.keep_identified)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, lambda d: line_dedup.drop_common_lines(d, min_docs=10, min_chars=1), texts=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, covering_simhash.one_of_each)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, lambda d: pseudonyms.pseudonymise(d, key=spark.conf.get("palimpsest.pseudonym.key", OPEN_KEY)), texts=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: No SQL can train the classifier or encode texts; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
