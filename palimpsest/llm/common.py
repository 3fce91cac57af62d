"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import saved, scratch

__all__ = ["BLANKS", "OPEN_KEY", "add_columns", "free_name", "saved", "scratch"]

#: White space of the corpus contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, all other bytes as they are; in UTF-8 these bytes stand for nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The pseudonym key of the registered queries and the pipeline: a parameter for all to read, so it protects nothing.
OPEN_KEY = "registered queries"


def add_columns(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """docs with columns added; an input column of the same name (in any case) gives way."""
    taken = {c.lower() for c in columns}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores in front until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name
