"""Packed labels: semantic class in the upper 16 bits, instance in the lower 16, read as unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def semantic(label: Column) -> Column:
    return F.shiftrightunsigned(label.cast("int"), 16).bitwiseAND(F.lit(0xFFFF))


def instance(label: Column) -> Column:
    return label.cast("int").bitwiseAND(F.lit(0xFFFF))


def pack(semantic: Column, instance: Column) -> Column:
    return F.shiftleft(semantic.cast("int"), 16).bitwiseOR(instance.cast("int").bitwiseAND(F.lit(0xFFFF)))


def symbol_index(name: Column) -> Column:
    """The number in a symbol such as O(12); null if there is none."""
    return F.regexp_extract(name, r"\((\d+)\)", 1).try_cast("long")


def safe_name(name: Column) -> Column:
    """A name with everything but letters, digits, dots and dashes as underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9.\-]+", "_")


def stamps_text(stamps: Column) -> Column:
    return F.array_join(stamps.cast("array<string>"), ":")


def fingerprint(*columns: Column) -> Column:
    """Digest of a group's rows that doesn't depend on their order: sums of two hashes, in constant memory."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)
